"""Near-duplicate paragraphs across the whole corpus: keep the first of each.

Paragraphs are deduplicated exactly first, so a blank line or a boilerplate line is
one row from then on. MinHash bands of the distinct paragraphs make buckets; the
paragraphs kept are those that a scan in document order would keep, which compares
with kept ones only. That set is found in parallel, round by round: in each bucket
the first undropped paragraph leads; one that leads in all its buckets is kept;
one that shares a bucket with a kept earlier one is dropped. Each round is two
aggregations over (paragraph, bucket) rows with partial results, so large buckets
never gather in a task, and is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrow import strings
from corpusflow.functions.fields import get_field, set_field
from corpusflow.functions.text import split_plain
from corpusflow.plans.base import MapFn
from corpusflow.plans.registry import components
from corpusflow.storage import materialize

PRIME = np.uint64(4294967311)
LIMIT = np.uint64(0xFFFFFFFF)
HALF, FIFTEEN = np.uint64(32), np.uint64(15)
MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
BLOCK = 64  # shingles at a time, so that their permutations stay in a core's cache
FEW = 2_000_000  # rows that one task scans
SCHEMA = pa.schema([("node", pa.int64()), ("bucket", pa.int64())])


def optimal_bands(permutations: int, threshold: float) -> tuple[int, int]:
    """The divisors (bands, rows) whose similarity threshold (1/b)^(1/r) is nearest to the one asked."""
    return min(((b, permutations // b) for b in range(1, permutations + 1) if permutations % b == 0), key=lambda x: abs((1 / x[0]) ** (1 / x[1]) - threshold))


class MinHash:
    def __init__(self, permutations: int = 256, shingle: int = 8, seed: int = 1854201893):
        r = np.random.default_rng(seed)
        self.a = r.integers(1, 1 << 32, permutations, dtype=np.uint64)
        self.b = r.integers(0, 1 << 32, permutations, dtype=np.uint64)
        self.shingle = shingle

    def hashes(self, text: str) -> np.ndarray:
        """The 32-bit hashes of the word shingles; a short text is one shingle."""
        ws = text.split()
        n = self.shingle
        grams = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or [" ".join(ws)]
        return pd.util.hash_array(np.array(grams, dtype=object), categorize=False) & LIMIT

    def signatures(self, texts: list[str]) -> np.ndarray:
        """A row a text: the least of each permutation over its shingles' hashes."""
        out = np.full((len(texts), len(self.a)), LIMIT)
        for k, t in enumerate(texts):
            h = self.hashes(t)
            for i in range(0, len(h), BLOCK):
                np.minimum(out[k], self.permuted(h[i : i + BLOCK]).min(axis=0), out=out[k])
        return out

    def permuted(self, h: np.ndarray) -> np.ndarray:
        """(h a + b) % PRIME % LIMIT without a division: 2^32 is -15 modulo PRIME."""
        x = np.multiply.outer(h, self.a)
        x += self.b
        high = x >> HALF
        high *= FIFTEEN
        x &= LIMIT
        x += FIFTEEN * PRIME
        x -= high
        np.right_shift(x, HALF, out=high)  # 16 at most
        high *= FIFTEEN
        x &= LIMIT
        x -= high
        for part in (PRIME, ~LIMIT + np.uint64(1)):  # where it is below 0, or not below LIMIT: the other value is past all others
            np.add(x, part, out=high)
            np.minimum(x, high, out=x)
        return x

    def keys(self, texts: list[str], bands: int) -> np.ndarray:
        """One 64-bit key a text and band, which knows its band."""
        s = self.signatures(texts).reshape(len(texts), bands, -1)
        x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX[0], s.shape[:2]).copy()
        for j in range(s.shape[2]):
            x = (x ^ (x >> np.uint64(29))) * MIX[1] + s[:, :, j]
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        return (x ^ (x >> np.uint64(27))).view(np.int64)

    def buckets(self, text: str, bands: int) -> list[int]:
        return self.keys([text], bands)[0].tolist()


def scan(pairs: pa.Table) -> list[int]:
    """The nodes that a scan in node order keeps, of rows (node, bucket)."""
    node, bucket = (pairs.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(node, kind="stable")
    node, bucket = node[order], bucket[order]
    taken: set[int] = set()
    kept = []
    for own in np.split(np.arange(len(node)), np.flatnonzero(np.diff(node)) + 1) if len(node) else ():
        keys = bucket[own].tolist()
        if taken.isdisjoint(keys):
            taken.update(keys)
            kept.append(int(node[own[0]]))
    return kept


def keep_first(nodes: DataFrame, few: int = FEW) -> DataFrame:
    """Of rows (node, bucket), the nodes that a scan in node order keeps; nodes are longs in document order.

    Nodes that share no bucket are kept at once; rounds go over the shared buckets' rows until
    these are few enough for one task.
    """
    every = materialize(nodes.select("node", "bucket"), "buckets")
    shared = every.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last").select("bucket")
    rows = materialize(every.join(shared, "bucket", "left_semi").distinct(), "buckets")
    kept = every.select("node").join(rows, "node", "left_anti").distinct()
    while (n := rows.count()) > few:
        lead = rows.groupBy("bucket").agg(F.min("node").alias("lead"))
        leads = rows.join(lead, "bucket").groupBy("node").agg(F.min(F.col("lead") == F.col("node")).alias("all_led"))
        new = materialize(leads.filter("all_led").select("node"), "kept")
        kept = kept.unionByName(new)
        taken = rows.join(new, "node", "left_semi").select("bucket").distinct()
        dropped = rows.join(taken, "bucket", "left_semi").select("node").distinct()  # the kept ones among them leave too
        rows = materialize(rows.join(dropped, "node", "left_anti"), "buckets")
    if n:

        def last(batches):
            yield pa.RecordBatch.from_arrays([pa.array(scan(pa.Table.from_batches(batches, SCHEMA)), pa.int64())], names=["node"])

        kept = kept.unionByName(rows.select("node", "bucket").coalesce(1).mapInArrow(last, "node long"))
    return kept


@components.add("format", "deduplication")
class Deduplication(MapFn):
    """Sizes of the reference's filter are accepted but not needed: the buckets here are exact."""

    name: str = Field(default="deduplication")
    bloom_size: int = Field(default=1_000_000, gt=0)
    bloom_hashes: int = Field(default=3, gt=0)
    memory: int = Field(default=256, gt=0)
    lsh_threshold: float = Field(default=0.8, gt=0, lt=1)
    lsh_permutations: int = Field(default=256, gt=0)
    lsh_ngram_size: int = Field(default=8, gt=0)
    split_char: str | None = Field(default="\n", description="What parts paragraphs; without it a text is one")
    order_by: str | None = Field(default=None, description="Field that orders documents (their order in the input otherwise)")
    near: bool = Field(default=True, description="Without it only exact copies go")

    def transform(self, df: DataFrame) -> DataFrame:
        order = get_field(df, self.order_by) if self.order_by else F.monotonically_increasing_id()
        base = materialize(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_order", order), "documents")
        t = get_field(base, self.on).cast("string")
        parts = split_plain(t, self.split_char) if self.split_char else F.array(t)
        own = base.filter(t.isNotNull() & (t != "")).select("_order", "_row", F.posexplode(parts).alias("_pos", "_text"))
        own = own.withColumn("_key", F.xxhash64("_text")).withColumn("_key2", F.xxhash64(F.lit(1), F.col("_text")))
        place = F.struct("_order", "_row", "_pos")
        first = own.groupBy("_key", "_key2").agg(F.min(place).alias("_first"), F.any_value("_text").alias("_text"))
        if self.near:
            # ranks in document order: sorted ranges number themselves, no row gathers in one task
            ranked = materialize(first.select("_first", "_text").repartitionByRange("_first").sortWithinPartitions("_first").withColumn("node", F.monotonically_increasing_id()), "paragraphs")
            m = MinHash(self.lsh_permutations, self.lsh_ngram_size)
            bands = optimal_bands(self.lsh_permutations, self.lsh_threshold)[0]

            def sign(batches):
                for b in batches:
                    for at in range(0, len(b), 500):
                        part = b.slice(at, 500)
                        keys = m.keys(strings(part.column(1)), bands)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), bands), pa.int64()), pa.array(keys.ravel(), pa.int64())], names=["node", "bucket"])

            kept = keep_first(ranked.select("node", "_text").mapInArrow(sign, "node long, bucket long"))
            first = ranked.join(kept, "node", "left_semi")
        winners = first.select(F.col("_first._row").alias("_row"), F.col("_first._pos").alias("_pos"))
        pieces = own.join(winners, ["_row", "_pos"], "left_semi").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "_text"))).alias("_kept"))
        text = F.array_join(F.transform("_kept", lambda x: x["_text"]), self.split_char or "")
        back = base.join(pieces.select("_row", text.alias("_new")), "_row", "left")
        old = get_field(back, self.on).cast("string")
        new: Column = F.when(old.isNull() | (old == ""), old).otherwise(F.coalesce("_new", F.lit("")))
        return set_field(back, self.to, new).drop("_row", "_order", "_new").select(*[c for c in set_field(df, self.to, F.lit("")).columns])

    __call__ = transform
