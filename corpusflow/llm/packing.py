"""Packing into optimal length buckets.

A document of more than ``max_len`` tokens is cut into pieces of ``max_len`` and a
rest, so nothing is lost. The histogram of piece lengths over the whole corpus has
at most ``max_len`` cells; a dynamic program over it chooses the bucket boundaries
with the least total padding. Inside a bucket the pieces, in order of (doc_id,
piece), form batches of as many sequences as the token budget holds.

The order inside a bucket is found without a single-task window: pieces are sorted
by ranges of (bucket, doc_id, piece, length, a number of the row), which hot ids
don't fill, and numbered there; the counts of the ranges before are added.

Defined cases: a null or empty text has no tokens and no piece; rows with equal
ids are separate documents; a null id sorts first; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import WORD_RE, materialize

RANGE_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0))


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets with the least padding.

    Padding of lengths i..j in one bucket is the sum of (length j - length) * count.
    Of equal costs the smaller last start wins, so the result is one.
    """
    o = np.argsort(lengths)
    ls, cs = np.array(lengths, np.int64)[o], np.array(counts, np.int64)[o]
    n = len(ls)
    if not n:
        return []
    c, t = np.r_[0, np.cumsum(cs)], np.r_[0, np.cumsum(cs * ls)]
    best = ls * c[1:] - t[1:]  # one bucket for lengths 0..j
    came = []
    for _ in range(1, min(buckets, n)):
        new, where = best.copy(), np.full(n, -1, np.int64)
        for j in range(1, n):
            i = np.arange(j)  # the last bucket holds lengths i+1..j
            cost = best[i] + ls[j] * (c[j + 1] - c[i + 1]) - (t[j + 1] - t[i + 1])
            k = int(np.argmin(cost))
            if cost[k] < new[j]:
                new[j], where[j] = cost[k], k
        came.append(where)
        best = new
    out, j = [], n - 1
    for where in reversed(came):
        if where[j] >= 0:
            out.append(int(ls[j]))
            j = int(where[j])
    out.append(int(ls[j]))
    return sorted(set(out))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, max_len: int = 2048, buckets: int = 16, budget: int = 32768) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket (its padded length), batch, slot, padding.

    ``length`` is the number of tokens of a row (default: its words); ``batch`` counts
    from 0 inside a bucket and holds ``budget // bucket`` sequences.
    """
    if budget < max_len:
        raise ValueError("the token budget must hold a sequence of max_len")
    n = (word_count(F.col(f"`{text_col}`")) if length is None else length).cast("long")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), n.alias("n")).filter("n > 0")
    last = F.floor((F.col("n") - 1) / max_len)
    pieces = d.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "piece", (F.col("piece") * max_len).alias("start"), F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).cast("long").alias("n_tokens")
    )
    pieces = materialize(pieces, "pieces")
    hist = pieces.groupBy("n_tokens").count().collect()  # at most max_len rows
    bounds = boundaries([r[0] for r in hist], [r[1] for r in hist], buckets)
    total = sum(r[1] for r in hist)
    bucket = F.lit(bounds[-1] if bounds else max_len)
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    own = pieces.withColumn("bucket", bucket.cast("long")).withColumn("tie", F.monotonically_increasing_id())
    keys = ["bucket", "doc_id", "piece", "n_tokens", "tie"]
    ranges = own.repartitionByRange(max(1, -(-total // RANGE_ROWS)), *keys).sortWithinPartitions(*keys)
    # the number of a row in its range, and above it the range's own
    placed = materialize(ranges.withColumn("place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("place", 33).alias("part")
    starts = placed.groupBy("bucket", part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))  # a row or two a range
    before = starts.select("bucket", "part", "first", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("part", part).join(before, ["bucket", "part"]).withColumn("at", F.col("place") - F.col("first") + F.col("before"))
    per = F.floor(F.lit(budget) / F.col("bucket"))
    return numbered.select(
        "doc_id", "piece", "start", "n_tokens", "bucket",
        F.floor(F.col("at") / per).cast("long").alias("batch"),
        F.pmod(F.col("at"), per).cast("long").alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
