"""Substring dedup by level-wise doubling.

A word goes if a window of ``width`` words over it also starts in a document with
a smaller doc_id. Levels double towards the width (7, then 13 words): a window is
a candidate at a level only if every window of the level before inside it, both
halves among them, occurs in more than one document, and only candidates are sent.
At levels below the width a tally (``blocks``) tells which candidates several
documents hold, at some two bytes for each distinct one of a block. At the width
the survivors alone are sent, with 96 bits of hash beside their shard and the
smallest doc_id of the block that holds them; what is larger than the smallest of
all blocks goes. Inside a block only the smallest doc_id's copies are sent, the
others are settled there, so a window that a third of all documents hold is one
entry a block. Texts lie in files by block and are never shuffled.

``dedup_substrings`` and its query end at the width, as longer windows can't remove
more. ``longest_repeats`` doubles on, to 2, 4, 8 ... times the width, until no
candidate survives, and gives each document the longest repeated length.

Defined cases: a null text has no words; a null doc_id takes no part and loses
nothing; rows with equal ids don't remove each other's words; words are judged on
the input; repeats inside one document alone stay; extra columns are ignored.
``docs`` should be a scan of files or another source that gives equal rows in
equal order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import blocks
from corpusflow.llm.common import GOLD, U64, lists, materialize, mix, record, roll, shared_path, text_hashes

SENT = "shard int, block long, w1 binary, w2 binary, ids binary, counts binary"
OUT = "doc_id long, n_words long, n_removed long, kept string"


def doubling(width: int) -> list[int]:
    """The levels: halves of halves from about seven words up, the width last."""
    out = [width]
    while len(out) == 1 or out[0] > 8:
        out.insert(0, -(-out[0] // 2))
    return out


class Windows:
    """The windows of a block's documents, each in one document; documents without an id have none."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        self.ids = np.array([i for i in ids if i is not None], np.int64)
        self.h, size = text_hashes([t for i, t in zip(ids, texts) if i is not None])
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), size)

    def starts(self, level: int) -> np.ndarray:
        n = max(0, len(self.h) - level + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[level - 1 :]) if n else np.zeros(0, np.int64)

    def names(self, level: int) -> np.ndarray:
        return mix(roll(self.h, level) ^ U64(level))

    def second_names(self, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (roll(mix(self.h + GOLD), level) >> U64(32)).astype(np.uint32)

    def cells(self, level: int, at: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sorted cells of the windows at ``at``, in how many documents (1, or 2 for more), and each window's place among them."""
        c = blocks.cells(self.names(level)[at], shards) if len(at) else np.zeros(0, np.uint64)
        distinct, n, place = blocks.places(c)
        if not len(c):
            return distinct, n, place
        # documents come in order, so the least and the largest place's owners tell whether one document holds all
        least, most = np.full(len(distinct), len(self.ids), np.int32), np.full(len(distinct), -1, np.int32)
        most[place] = self.doc[at]
        least[place[::-1]] = self.doc[at][::-1]
        return distinct, 1 + (least != most), place

    def extended(self, level: int, before: int, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows of ``level`` words all of whose windows of ``before`` words start in ``repeated``."""
        on = np.zeros(len(self.h) + 1, np.int32)
        on[repeated] = 1
        total = np.r_[0, np.cumsum(on)]
        at, k = self.starts(level), level - before + 1
        return at[total[at + k] - total[at] == k]


def _load(path: str, block: int) -> tuple[list[int | None], list[bytes]]:
    t = blocks.read(path, f"{block}.texts")
    return t["doc_id"].to_pylist(), t["text"].to_pylist()


def _first(path: str, levels: list[int], shards: int, block_words: int):
    def run(batches):
        for block, rows in blocks.cut(batches, ["doc_id", "text"], block_words):
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
            raw = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
            blocks.write(path, f"{block}.texts", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array(raw, pa.large_binary())}), "zstd")
            w = Windows([i for i, _ in rows], raw)
            distinct, times, _ = w.cells(levels[0], w.starts(levels[0]), shards)
            yield blocks.message(block, distinct, times, shards)

    return run


def _survivors(path: str, levels: list[int], k: int, shards: int, block: int, table: pa.Table) -> tuple[Windows, np.ndarray]:
    """The block's windows and the starts of the candidates of level k, by the tally of level k - 1."""
    w = Windows(*_load(path, block))
    at = w.starts(levels[0]) if k == 1 else blocks.read(path, f"{block}.{levels[k - 1]}")["at"].to_numpy()
    _, _, place = w.cells(levels[k - 1], at, shards)
    return w, w.extended(levels[k], levels[k - 1], at[blocks.ranks(table)[place] > 0])


def _next(path: str, levels: list[int], k: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        w, at = _survivors(path, levels, k, shards, block, table)
        blocks.write(path, f"{block}.{levels[k]}", pa.table({"at": at}), "zstd")
        distinct, times, _ = w.cells(levels[k], at, shards)
        return pa.Table.from_batches([blocks.message(block, distinct, times, shards)])

    return run


def equal_runs(w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs are neighbours, and where each run of them begins."""
    o = np.argsort(w1)
    one, two = w1[o], w2[o]
    same = one[1:] == one[:-1]
    if (same & (two[1:] != two[:-1])).any():  # a first hash that several windows share
        o = np.lexsort((w2, w1))
        one, two = w1[o], w2[o]
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    return o, np.r_[True, ~same] if len(o) else np.zeros(0, bool)


def _last(path: str, levels: list[int], shards: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        w, at = _survivors(path, levels, len(levels) - 1, shards, block, table)
        w1, w2 = w.names(levels[-1])[at] if len(at) else np.zeros(0, np.uint64), w.second_names(levels[-1])[at] if len(at) else np.zeros(0, np.uint32)
        o, new = equal_runs(w1, w2)
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        owner = np.minimum.reduceat(w.doc[at[o]], first) if len(o) else np.zeros(0, np.int32)  # documents are in order of doc_id
        at, w1, w2 = at[o], w1[o][first], w2[o][first]
        later = w.ids[w.doc[at]] > w.ids[owner][group] if len(at) else np.zeros(0, bool)
        shard = ((w1 >> U64(40)) % U64(shards)).astype(np.int32)
        s = np.lexsort((owner, shard))
        place = np.empty(len(s), np.int64)
        place[s] = np.arange(len(s))
        stay = ~later
        blocks.write(path, f"{block}.gone", pa.table({"at": at[later]}), "zstd")
        blocks.write(path, f"{block}.open", pa.table({"at": at[stay], "place": place[group[stay]]}), "zstd")
        w1, w2, owner, shard = w1[s], w2[s], owner[s], shard[s]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        used, cols = [k for k in range(shards) if cuts[k] < cuts[k + 1]], {c: [] for c in ("w1", "w2", "ids", "counts")}
        for k in used:
            r = slice(cuts[k], cuts[k + 1])
            own, n = np.unique(owner[r], return_counts=True)
            for c, x in zip(cols, (w1[r].astype("<u8"), w2[r].astype("<u4"), w.ids[own].astype("<i8"), n.astype("<u4"))):
                cols[c].append(x.tobytes())
        return pa.table({"shard": pa.array([*used, block % shards], pa.int32()), "block": pa.array([block] * (len(used) + 1), pa.int64())} | {c: pa.array([*v, None], pa.binary()) for c, v in cols.items()})

    return run


def _least(table: pa.Table) -> pa.Table:
    """Of each window sent, whether another block holds it in a document with a smaller id."""
    named = table.filter(pa.compute.is_null(table["w1"]))
    rows = table.filter(pa.compute.is_valid(table["w1"]))
    replies = []
    if rows.num_rows:
        parts = rows["w1"].to_pylist()
        w1, w2 = np.frombuffer(b"".join(parts), "<u8"), np.frombuffer(b"".join(rows["w2"].to_pylist()), "<u4")
        ids = np.repeat(np.frombuffer(b"".join(rows["ids"].to_pylist()), "<i8"), np.frombuffer(b"".join(rows["counts"].to_pylist()), "<u4"))
        o, new = equal_runs(w1, w2)
        least = np.minimum.reduceat(ids[o], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = np.empty(len(o), np.uint8)
        gone[o] = ids[o] > least
        replies = [x.tobytes() for x in np.split(gone, np.cumsum([len(p) // 8 for p in parts])[:-1])]
    return pa.table({"block": pa.array(rows["block"].to_pylist() + named["block"].to_pylist(), pa.int64()), "shard": pa.array(rows["shard"].to_pylist() + [-1] * named.num_rows, pa.int32()), "ranks": pa.array(replies + [None] * named.num_rows, pa.binary())})


def _cover(path: str, width: int, digest: bool):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        ids, texts = _load(path, block)
        still = blocks.read(path, f"{block}.open")
        starts = np.r_[blocks.read(path, f"{block}.gone")["at"].to_numpy(), still["at"].to_numpy()[blocks.ranks(table)[still["place"].to_numpy()] > 0]]
        words = [t.split() for t in texts]
        edge = np.zeros(sum(map(len, words)) + 1, np.int64)
        edge[starts] += 1
        np.add.at(edge, starts + width, -1)
        on = np.cumsum(edge) > 0
        removed, kept, at = [0] * len(ids), [], 0
        for k, ws in enumerate(words):
            if ids[k] is not None:
                gone = on[at : at + len(ws)]
                at += len(ws)
                if gone.any():
                    removed[k] = int(gone.sum())
                    ws = [ws[i] for i in np.flatnonzero(~gone)]
            text = b" ".join(ws)
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "surrogatepass"))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(ws) for ws in words], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, digest: bool = False, block_words: int = blocks.BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words (``kept``, or ``kept_sha256`` with ``digest``)."""
    if width < 2:
        raise ValueError("a window has at least two words")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shards, parts = blocks.plan_sizes(blocks.input_bytes(d, F.col("text")), block_words)
    path, levels = shared_path(docs.sparkSession, "windows"), doubling(width)
    sent = d.mapInArrow(_first(path, levels, shards, block_words), blocks.MESSAGE)
    for k in range(1, len(levels) - 1):
        sent = blocks.tally(sent, shards, parts).applyInArrow(blocks.lean(_next(path, levels, k, shards)), blocks.MESSAGE)
    last = blocks.tally(sent, shards, parts).applyInArrow(blocks.lean(_last(path, levels, shards)), SENT)
    replies = blocks.by_shard(last, shards).applyInArrow(blocks.lean(_least), blocks.REPLY)
    out = blocks.by_block(replies, parts).applyInArrow(blocks.lean(_cover(path, width, digest)), OUT)
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(doc_id, longest): the largest width * 2^k at which a window of the document occurs in another document.

    Level by level: a window twice as long is a candidate only if both its halves
    were repeated at the level before; the loop ends when no candidate survives.
    Rows are (doc_id, position, 64-bit name); a level costs one exchange by
    document and one by name, with partial aggregation, over the survivors alone.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id IS NOT NULL")

    def named(batches):
        for b in batches:
            for i, t in zip(*lists(b, "doc_id", "text")):
                w = Windows([i], [(t or "").encode("utf-8", "surrogatepass")])
                at = w.starts(width)
                if len(at):
                    yield record(doc_id=(np.full(len(at), i), pa.int64()), pos=(at, pa.int64()), name=(w.names(width)[at].astype(np.int64), pa.int64()))

    level, rows, found = width, d.mapInArrow(named, "doc_id long, pos long, name long"), []
    while True:
        names = rows.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("name")
        rows = materialize(rows.join(names, "name", "left_semi"), f"repeats-{level}")
        if rows.isEmpty():
            break
        found.append(rows.select("doc_id").distinct().withColumn("longest", F.lit(level).cast("long")))
        right = rows.select("doc_id", (F.col("pos") - level).alias("pos"), F.col("name").alias("next"))
        rows = rows.join(right, ["doc_id", "pos"]).select("doc_id", "pos", F.xxhash64("name", "next").alias("name"))
        level *= 2
    out = d.select("doc_id").distinct()
    for f in found:
        out = out.join(f.withColumnRenamed("longest", "l"), "doc_id", "left").withColumn("longest", F.coalesce("l", *(["longest"] if "longest" in out.columns else [F.lit(0).cast("long")]))).drop("l")
    return out if found else out.withColumn("longest", F.lit(0).cast("long"))
