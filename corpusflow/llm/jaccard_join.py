"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections.

Finds every pair of documents whose sets of 3-word shingles have a Jaccard
similarity of at least ``threshold`` percent, exactly. The steps:

1. Blocks of documents keep their sets as files; a tally (``blocks``) tells how
   widely each shingle is held. A document with fewer shingles than the
   threshold's share that others hold too can't have a partner and ends here.
   Documents with equal sets (128-bit digest) form a class; one stands for all.
2. A set's prefix, rare shingles first, is what any partner must touch (set size
   less the least overlap, plus one). Sets that share a shingle of their prefixes
   and whose sizes allow a link are chained in order of size; what hangs together
   is a field, outside which no set has a partner.
3. Sets lie in tiles by field and size band, of bounded size. Pairs of tiles whose
   bands allow a link are the units of comparison: a set is sent once to each unit
   of its tile, most often one. In a unit, hashed bitmaps bound every pair's overlap
   from above by bit counts; pairs that pass are intersected exactly, as sorted
   arrays.
4. A unit returns each set's number of linked documents and a spanning forest of its
   links, not the links. Forests are joined into components by labels that pass
   along links and jump, over any number of partitions.

Classes aren't expanded into pairs, and pairs aren't shuffled. Shards, units and
partitions are in proportion to the input's size.

Defined cases: null or empty texts have no shingle and no link; a null doc_id
takes no part (n_similar 0, component_id null); rows with equal ids are separate
documents; equal texts are always linked; extra columns are ignored. ``docs``
should be a scan of files or another source that gives equal rows in equal order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import blocks
from corpusflow.llm.common import U64, lower_ascii, materialize, mix, record, roll, shared_path, text_hashes

TILE = 512
UNIT_BYTES = 16_000_000
FOREST = 4_000_000  # links in a partition
BAND = 1.25
BITS = 2048


def shingle_hashes(text: str | None, n: int = 3) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted 64-bit hashes."""
    return block_shingles([text], n)[0]


def block_shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The shingle sets of a block of texts; a text of fewer words is one shingle."""
    h, counts = text_hashes([lower_ascii((t or "").encode("utf-8", "surrogatepass")) for t in texts])
    whole = mix(roll(h, n) ^ U64(n))
    out, at = [], 0
    for k in counts.tolist():
        s = np.sort(whole[at : at + k - n + 1]) if k >= n else mix(roll(h[at : at + k], k) ^ U64(k)) if k else np.zeros(0, np.uint64)
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        at += k
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(d[0]), int(d[1])


def least_overlap(a, b, threshold: int):
    """The least intersection for which 100 * i >= threshold * (a + b - i)."""
    return -(-threshold * (a + b) // (100 + threshold))


_ROWS = "doc_id long, d1 long, d2 long, n int, maybe boolean, cid long"
ENTRY = np.dtype([("t", "<u8"), ("d", "<i8"), ("n", "<u4")])


def _first(path: str, n: int, shards: int, block_words: int):
    def run(batches):
        for block, rows in blocks.cut(batches, ["doc_id", "text"], block_words):
            sets = block_shingles([t for _, t in rows], n)
            d = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            size = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate(sets)
            ids = pa.array([i for i, _ in rows], pa.int64())
            blocks.write(path, f"{block}.sets", pa.table({"doc_id": ids, "d1": d[:, 0], "d2": d[:, 1], "n": size, "tokens": pa.array([s.tobytes() for s in sets], pa.large_binary())}))
            there = np.repeat(~ids.is_null().to_numpy(False), size)
            distinct, times, _ = blocks.places(blocks.cells(tokens[there], shards))
            yield blocks.message(block, distinct, times, shards)

    return run


def _held(path: str, shards: int, threshold: int):
    """The block's documents, and which may have a partner; keeps the ranks of those documents' shingles."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        t = blocks.read(path, f"{block}.sets")
        size, null = t["n"].to_numpy(), t["doc_id"].is_null().to_numpy()
        there = np.repeat(~null, size)
        tokens = np.frombuffer(b"".join(t["tokens"].to_pylist()), "<u8")
        rank = np.zeros(len(tokens), np.uint8)
        _, _, place = blocks.places(blocks.cells(tokens[there], shards))
        rank[there] = blocks.ranks(table)[place]
        owner = np.repeat(np.arange(len(size)), size)
        held = np.bincount(owner[rank > 0], minlength=len(size))
        maybe = (size > 0) & (100 * held >= threshold * size)
        at, cuts = np.flatnonzero(maybe), np.r_[0, np.cumsum(size)]
        blocks.write(path, f"{block}.ranks", pa.table({"ord": at, "ranks": pa.array([rank[cuts[k] : cuts[k + 1]].tobytes() for k in at], pa.large_binary())}), "zstd")
        return pa.table({"doc_id": t["doc_id"], "d1": t["d1"], "d2": t["d2"], "n": pa.array(size, pa.int32()), "maybe": pa.array(maybe), "cid": pa.array(block << 16 | np.arange(len(size)), pa.int64())})

    return run


def _prefixes(path: str, threshold: int, shards: int):
    """The prefixes of a block's representatives, by shard."""

    def run(table: pa.Table) -> pa.Table:
        cid = np.sort(table["cid"].to_numpy())
        block, at = int(cid[0]) >> 16, cid & 0xFFFF
        tokens = blocks.read(path, f"{block}.sets")["tokens"].take(pa.array(at)).to_pylist()
        ranked = blocks.read(path, f"{block}.ranks")
        ranks = ranked["ranks"].take(pa.array(np.searchsorted(ranked["ord"].to_numpy(), at))).to_pylist()
        tok, rank = np.frombuffer(b"".join(tokens), "<u8"), np.frombuffer(b"".join(ranks), np.uint8)
        size = np.array([len(x) for x in ranks], np.int64)
        owner = np.repeat(np.arange(len(at)), size)
        o = np.lexsort((tok, rank, owner))
        p = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
        inside = p < (size + threshold * size // -100 + 1)[owner]  # size - ceil(threshold * size / 100) + 1
        e = np.zeros(int(inside.sum()), ENTRY)
        e["t"], e["d"], e["n"] = tok[o][inside], cid[owner[inside]], size[owner[inside]]
        shard = ((e["t"] >> U64(40)) % U64(shards)).astype(np.int32)
        q = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[q], np.arange(shards + 1))
        used = [k for k in range(shards) if cuts[k] < cuts[k + 1]]
        return pa.table({"shard": pa.array(used, pa.int32()), "entries": pa.array([e[q[cuts[k] : cuts[k + 1]]].tobytes() for k in used], pa.binary())})

    return run


def _chain(threshold: int):
    """A spanning forest of a shard's chains of sets that share a prefix shingle, by size."""

    def run(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY)
        e = e[np.lexsort((e["d"], e["n"], e["t"]))]
        near = (e["t"][1:] == e["t"][:-1]) & (100 * e["n"][:-1].astype(np.int64) >= threshold * e["n"][1:].astype(np.int64))
        node, root = forest(e["d"][:-1][near], e["d"][1:][near])
        return pa.table({"a": pa.array(root, pa.int64()), "b": pa.array(node, pa.int64())})

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of links a - b that aren't roots; a root is its component's least node."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        on = low < high
        if not on.any():
            break
        x, y = x[on], y[on]
        np.minimum.at(label, high[on], low[on])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    below = label < np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def _forest(batches):
    """A spanning forest of a partition's links: (root, node)."""
    held, size = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > FOREST:  # what was seen so far shrinks to its forest
            node, root = forest(*(np.concatenate(c) for c in zip(*held)))
            held, size = [(root, node)], len(node)
    if held:
        node, root = forest(*(np.concatenate(c) for c in zip(*held)))
        for c in range(0, len(node), 65_536):
            yield record(a=(root[c : c + 65_536], pa.int64()), b=(node[c : c + 65_536], pa.int64()))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that links (a, b) touch, apart from the roots: root is the component's least node.

    Partitions first reduce their links to spanning forests. Labels then pass along
    links and jump to their labels' labels until nothing changes.
    """
    links = materialize(links.select("a", "b").mapInArrow(_forest, "a long, b long"), "forests")
    # links of a root meet in partitions of a bounded number of them, which leaves few to pass labels along
    trees = links.repartition(max(1, -(-links.count() // FOREST)), "a").mapInArrow(_forest, "a long, b long")
    both = materialize(trees.select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).selectExpr("if(s = 0, a, b) AS a", "if(s = 0, b, a) AS b"), "links")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    while True:
        label = materialize(label, "labels")
        seen = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialize(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        if new.filter("old <> root").isEmpty():
            return new.filter("node <> root").select("node", "root")
        label = new.select("node", "root")


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's hashed bitmap."""
    m = np.zeros(BITS, bool)
    m[(s & U64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(m).view(np.uint64)


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets between two tiles, or inside one (``right`` None, first index smaller).

    Sets are sorted arrays of distinct numbers. Bits that only one of two bitmaps has
    stand for shingles that only one set has, which bounds the overlap from above.
    """
    inside = right is None
    right = left if inside else right
    m, mr = (np.stack([bitmap(s) for s in x]) for x in (left, right))
    n, nr = (np.array([len(s) for s in x], np.int64) for x in (left, right))
    start = np.r_[0, np.cumsum(nr)]
    vocabulary, local = np.unique(np.concatenate(right), return_inverse=True)
    mark = np.zeros(len(vocabulary), bool)
    found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for i, s in enumerate(left):
        j = np.arange(i + 1 if inside else 0, len(right))
        j = j[(100 * np.minimum(n[i], nr[j]) >= threshold * np.maximum(n[i], nr[j]))]
        if not len(j):
            continue
        need = least_overlap(n[i], nr[j], threshold)
        at_most = np.minimum(n[i] - np.bitwise_count(m[i] & ~mr[j]).sum(axis=1, dtype=np.int64), nr[j] - np.bitwise_count(mr[j] & ~m[i]).sum(axis=1, dtype=np.int64))
        ok = at_most >= need
        j, need = j[ok], need[ok]
        if not len(j):
            continue
        at = np.searchsorted(vocabulary, s)
        at = at[at < len(vocabulary)]
        at = at[np.isin(vocabulary[at], s, assume_unique=True)]
        mark[at] = True
        size = nr[j]
        ends = np.cumsum(size)
        rows = np.repeat(start[j] - ends + size, size) + np.arange(ends[-1])
        both = np.add.reduceat(mark[local[rows]], ends - size, dtype=np.int64)
        mark[at] = False
        j = j[both >= need]
        found[0].append(np.full(len(j), i))
        found[1].append(j)
    return np.concatenate(found[0]), np.concatenate(found[1])


_SENT = "g int, unit long, side int, cid long, size long, tokens binary"


def _ship(path: str):
    """The sets that a block's representatives send to the units of their tiles."""

    def run(table: pa.Table) -> pa.Table:
        block = int(table["cid"][0].as_py()) >> 16
        tokens = blocks.read(path, f"{block}.sets")["tokens"].take(pa.array(table["cid"].to_numpy() & 0xFFFF)).cast(pa.binary())
        return pa.table({c: table[c] for c in ("g", "unit", "side", "cid", "size")} | {"tokens": tokens})

    return run


def _compare(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        o = np.lexsort((table["cid"].to_numpy(), table["side"].to_numpy(), table["unit"].to_numpy()))
        unit, side, cid, size = (table[c].to_numpy()[o] for c in ("unit", "side", "cid", "size"))
        blobs = table["tokens"].take(pa.array(o)).to_pylist()
        cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:]):
            sets = [np.frombuffer(x, "<u8") for x in blobs[a:b]]
            k = int((side[a:b] == 0).sum())
            i, j = compare(sets[:k], sets[k:] if k < b - a else None, threshold)
            if not len(i):
                continue
            j = j + (k if k < b - a else 0)
            ids, w = cid[a:b], size[a:b]
            others = np.bincount(i, w[j], b - a) + np.bincount(j, w[i], b - a)
            at = np.flatnonzero(others)
            node, root = forest(ids[i], ids[j])
            out[0] += [ids[at], node]
            out[1] += [np.zeros(len(at), np.int64) - 1, root]
            out[2] += [others[at].astype(np.int64), np.zeros(len(node), np.int64)]
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "others": pa.array(cols[2], pa.int64())})

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: int = 70, block_words: int = blocks.BLOCK_WORDS, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_similar, component_id."""
    if not 0 < threshold <= 100:
        raise ValueError("the threshold is a percentage above 0")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shards, parts = blocks.plan_sizes(blocks.input_bytes(d, F.col("text")), block_words)
    path = shared_path(docs.sparkSession, "shingles")
    block = F.shiftright("cid", 16)

    def by_block(df: DataFrame) -> DataFrame:
        return blocks.by_block(df.withColumn("block", block), parts)

    replies = blocks.tally(d.mapInArrow(_first(path, n, shards, block_words), blocks.MESSAGE), shards, parts)
    rows = materialize(replies.applyInArrow(blocks.lean(_held(path, shards, threshold)), _ROWS), "documents")

    # classes of equal sets; one document stands for each class that may have a partner outside
    classes = materialize(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least"), F.max("maybe").alias("maybe"), F.min(F.when(F.col("maybe"), F.col("cid"))).alias("cid")), "classes")
    reps = classes.filter("maybe").select("cid", "n", "size")

    # fields of sets that prefixes chain
    entries = by_block(reps.select("cid")).applyInArrow(blocks.lean(_prefixes(path, threshold, shards)), "shard int, entries binary")
    chains = blocks.by_shard(entries, shards).applyInArrow(blocks.lean(_chain(threshold)), "a long, b long")
    roots = components(chains)
    field = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "fields")

    # tiles by field and size band; a field that fits into one tile needs no bands
    sets = reps.join(field.select(F.col("node").alias("cid"), F.col("root").alias("field")), "cid")
    sets = materialize(sets.withColumn("band", F.floor(F.log(F.col("n")) / float(np.log(BAND))).cast("int")), "sets")
    held = sets.groupBy("field").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") > tile).select("field", F.lit(True).alias("large"))
    sets = sets.join(held, "field", "left").withColumn("band", F.when(F.col("large"), F.col("band")).otherwise(0))
    counts = sets.groupBy("field", "band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    sets = sets.join(counts, ["field", "band"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    tiles = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("field", "band", "part")
    reach = int(np.ceil(np.log(100 / threshold) / np.log(BAND)))
    other = tiles.select(F.col("field").alias("field2"), F.col("band").alias("band2"), F.col("part").alias("part2"))
    units = tiles.join(other, (F.col("field") == F.col("field2")) & (F.abs(F.col("band") - F.col("band2")) <= reach) & (F.struct("band", "part") <= F.struct("band2", "part2")))
    units = materialize(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    ends = units.select("unit", "field", "band", "part", F.lit(0).alias("side")).unionByName(
        units.filter("band <> band2 OR part <> part2").select("unit", "field", F.col("band2").alias("band"), F.col("part2").alias("part"), F.lit(1).alias("side")))
    sends = materialize(sets.join(ends, ["field", "band", "part"]).select("unit", "side", "cid", "n", "size"), "sends")
    groups = max(8, -(-(sends.agg(F.sum("n")).first()[0] or 0) * 8 // UNIT_BYTES))
    sent = by_block(sends.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int")).select("g", "unit", "side", "cid", "size")).applyInArrow(blocks.lean(_ship(path)), _SENT)
    found = materialize(blocks.by_shard(sent, groups, "g").applyInArrow(blocks.lean(_compare(threshold)), "a long, b long, others long"), "links")

    others = found.filter("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("others").alias("others"))
    roots = components(found.filter("b >= 0"))
    alone = F.col("root").isNull()
    linked = classes.filter("maybe").join(others, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").filter(F.col("others").isNotNull() | (F.col("size") > 1))
    linked = linked.unionByName(classes.filter("NOT maybe AND size > 1"), allowMissingColumns=True).withColumn("root", F.when(alone, F.coalesce("cid", F.xxhash64("d1", "d2"))).otherwise(F.col("root")))
    linked = materialize(linked.select("d1", "d2", "size", "least", "others", "root"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = linked.join(least, "root").select("d1", "d2", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), "component_id")
    # a class that a large share of all rows has is a skewed key of this join, which adaptive execution splits
    return rows.join(answer, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_similar", F.lit(0))).cast("long").alias("n_similar"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
