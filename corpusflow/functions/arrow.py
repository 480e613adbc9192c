"""Functions of texts in Arrow-fed workers, whose memory doesn't grow with the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1 << 18  # bytes of text that are Python objects at a time


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[pa.Array]:
    """Slices of at most so many bytes each, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def strings(texts: pa.Array) -> list[str | None]:
    """Python strings; bytes that aren't UTF-8 are replaced, as Java's are."""
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [x if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]


def text_udf(kind: str, make: Callable[[], Callable[[list[str | None]], pa.Array]], size: int = PIECE) -> Callable[[Column], Column]:
    """A function of a text column. ``make`` runs once a task and gives what turns some texts into an array.

    Batches may hold ten thousand texts. Only a piece of one is Python objects at a time, and
    each piece's result is sent on by itself.
    """

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for b in batches:
            for p in pieces(b, size):
                yield of(strings(p))

    return run
