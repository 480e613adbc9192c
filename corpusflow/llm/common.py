"""What the operators share: shared storage, Arrow helpers, word hashing.

Rows with a null id are kept by every operator; they take no part in whatever
compares documents by id. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.storage import materialize, shared_dir, shared_path

U64 = np.uint64
MIX1, MIX2, GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
WORD_RE = r"[^\x20\x09-\x0D]+"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark understands, for the workers, and the path in it."""
    if path.startswith(("s3a://", "s3n://")):
        path = "s3://" + path.split("://", 1)[1]
    elif path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def record(**cols) -> pa.RecordBatch:
    """A batch of (values, type) pairs by name."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in cols.values()], names=list(cols))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """The words of a text, unchanged, as UTF-8; bytes.split() splits at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(b: bytes) -> bytes:
    return b.translate(_LOWER)


def hash_words(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not ws:
        return np.zeros(0, np.uint64)
    a = np.empty(len(ws), dtype=object)
    a[:] = ws
    return pd.util.hash_array(a, categorize=False)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = U64(0xD1342543DE82EF95)
_POWERS = np.cumprod(np.r_[U64(1), np.full(255, _BASE)])
CHUNK = 1 << 20


def text_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, number of words of each text), without an object a word.

    A word's hash is a polynomial of a random number for each of its bytes. Texts go
    in chunks of some megabyte, so that the arrays stay small.
    """
    hashes, counts, held, size = [], [], [], 0
    for k, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= CHUNK or k == len(texts) - 1:
            h, n = _hash_chunk(held)
            hashes.append(h)
            counts.append(n)
            held, size = [], 0
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _hash_chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    inside = ~_SPACE[buf]
    edge = np.diff(np.r_[np.int8(0), inside.view(np.int8), np.int8(0)])
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    size = stop - start
    first = np.cumsum(size) - size
    local = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = _POWERS
    if int(size.max()) > len(powers):
        powers = np.cumprod(np.r_[U64(1), np.full(int(size.max()) - 1, _BASE)])
    h = np.add.reduceat(_BYTE[buf[inside]] * powers[local], first) + size.astype(np.uint64)
    return mix(h), np.diff(np.r_[0, np.searchsorted(start, ends)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX1
        x = (x ^ (x >> U64(27))) * MIX2
        return x ^ (x >> U64(31))


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes, order-sensitive."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            x = (x ^ (x >> U64(29))) * MIX2 + h[k : k + m]
    return mix(x)


def clean(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under inner names, so that extra or clashing ones don't matter."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def salted(key: Column, rows: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, rows), F.lit(n))


def chunks(it: Iterable, size: int) -> Iterator[list]:
    out = []
    for x in it:
        out.append(x)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def union_all(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


__all__ = [n for n in dir() if not n.startswith("_")]
