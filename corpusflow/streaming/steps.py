"""The same steps over unbounded input.

Maps and filters keep no state, so they apply to a streaming frame as they are.
Exact deduplication keeps its keys within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans.base import apply_steps


def drop_exact_copies(stream: DataFrame, time_col: str, on: str = "text", delay: str = "1 hour") -> DataFrame:
    """The first row of each text; a copy later than ``delay`` after it counts as new, which bounds the state."""
    keyed = stream.withColumn("_key", F.sha2(F.col(on), 256))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


__all__ = ["apply_steps", "drop_exact_copies"]
