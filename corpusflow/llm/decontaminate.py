"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size, so what is broadcast never grows
with the benchmark. Every n-gram of an item is a seed: counts in the corpus don't
choose among them, as a form that leaked widely would lose its seeds to n-grams
that it broke or that only another form has. One pass a block finds seed hits in
every whole text, leaves out items too few of whose words the text has for any
alignment to reach ``threshold``, takes the window round each hit's diagonal, and
aligns the item with it by Smith-Waterman over words: 2 for a match, -1 for a
mismatch or gap. The score is divided by that of a perfect copy. A pair at or
above ``threshold`` is a leak.

Words are runs of letters, digits and underscores, lower-cased. An item with
fewer words than the n-gram length is its own n-gram.

Defined cases: null or empty texts and items match nothing; rows with equal ids
are separate documents; equal items are each reported; an empty benchmark gives no
row; of equal scores in a document the earliest window is reported.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import U64, lists, roll, text_hashes

TOKEN = re.compile(r"\w+")
FILTER_BITS = 22
BLOCK_CHARS = 8_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


_APART = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """The text in lower case with a space for whatever isn't in a token."""
    t = (text or "").lower()
    if not t.isascii():
        for c in set(t):
            if c > "\x7f" and not c.isalnum():
                t = t.replace(c, " ")
    return t.encode("utf-8", "surrogatepass").translate(_APART)


def hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's token hashes; a batch of texts is hashed at once."""
    h, n = text_hashes([plain(t) for t in texts])
    return np.split(h, np.cumsum(n)[:-1]) if texts else []


class Seeds:
    """The n-grams of a block of items as sorted hashes, with a bit filter before them."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.ids, self.words = [], []
        for (i, _), h in zip(items, hashes([t for _, t in items])):
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        self.sizes = sorted({min(n, len(h)) for h in self.words})
        keys, item, pos = [], [], []
        for k, h in enumerate(self.words):
            g = self.grams(h, min(n, len(h)))
            keys.append(g)
            item.append(np.full(len(g), k))
            pos.append(np.arange(len(g)))
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        self.key, self.item, self.pos = cat(keys, np.uint64), cat(item, np.int32), cat(pos, np.int32)
        o = np.lexsort((self.pos, self.item, self.key))
        self.key, self.item, self.pos = self.key[o], self.item[o], self.pos[o]
        self.distinct = np.unique(self.key)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.distinct & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        self.flat = cat(self.words, np.uint64)
        self.length = np.array([len(h) for h in self.words], np.int64)
        self.first = np.cumsum(self.length) - self.length

    @staticmethod
    def grams(h: np.ndarray, size: int) -> np.ndarray:
        return roll(h, size) ^ U64(size)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the distinct keys, position) of each hit in a document's word hashes."""
        at, where = [], []
        for size in self.sizes:
            g = self.grams(h, size)
            if not len(g):
                continue
            p = np.flatnonzero(self.bits[(g & U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            if not len(p) or not len(self.distinct):
                continue
            i = np.minimum(np.searchsorted(self.distinct, g[p]), len(self.distinct) - 1)
            ok = self.distinct[i] == g[p]
            at.append(i[ok])
            where.append(p[ok])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(where)


def _rows(item: np.ndarray, window: np.ndarray, local: bool):
    """The rows of the alignment matrix one after another; with ``local`` no cell is below zero."""
    j = np.arange(len(window) + 1, dtype=np.int64)
    last = np.zeros(len(j), np.int64) if local else GAP * j
    yield last
    for i, word in enumerate(item.tolist(), 1):
        row = np.empty(len(j), np.int64)
        row[0] = 0 if local else GAP * i
        row[1:] = np.maximum(last[:-1] + np.where(window == np.uint64(word), MATCH, MISMATCH), last[1:] + GAP)
        if local:
            np.maximum(row, 0, out=row)
        last = np.maximum.accumulate(row - GAP * j) + GAP * j
        yield last


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first and last + 1 word of the window in it).

    Only two rows of the matrix are held at a time. The best score's first end is found
    forward, then its start by aligning backward from there.
    """
    score, i, e = 0, 0, 0
    for k, row in enumerate(_rows(item, window, True)):
        at = int(row.argmax())
        if row[at] > score:
            score, i, e = int(row[at]), k, at
    if not score:
        return 0, 0, 0
    back = window[max(0, e - 3 * i) : e][::-1]  # a longer stretch has more gaps than the matches are worth
    for row in _rows(item[:i][::-1], back, False):
        at = np.flatnonzero(row == score)
        if len(at):
            return score, e - int(at[0]), e
    raise AssertionError("an alignment has a start")


def leaks(seeds: Seeds, h: np.ndarray, threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item index, score, first word, last word + 1, seed hits) of every item leaked into a document."""
    at, where = seeds.find(h)
    if not len(at):
        return []
    lo, hi = np.searchsorted(seeds.key, seeds.distinct[at]), np.searchsorted(seeds.key, seeds.distinct[at], "right")
    n = hi - lo
    entry = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    item, begin = seeds.item[entry], np.repeat(where, n) - seeds.pos[entry]
    found = np.unique(item)
    size = seeds.length[found]
    ends = np.cumsum(size)
    own = seeds.flat[np.repeat(seeds.first[found] - ends + size, size) + np.arange(ends[-1])]
    held = np.add.reduceat(np.isin(own, h), ends - size, dtype=np.int64)
    found = found[held >= threshold * size]
    if not len(found):
        return []
    ok = np.isin(item, found)
    item, begin = item[ok], begin[ok]
    o = np.lexsort((begin, item))
    item, begin = item[o], begin[o]
    out = []
    for k in found.tolist():
        own = seeds.words[k]
        m, starts = len(own), begin[item == k]
        slack = m // 2 + 5
        groups = np.split(starts, np.flatnonzero(np.diff(starts) > 2 * slack + m) + 1)
        best = None
        for g in groups:
            a, b = max(0, int(g[0]) - slack), min(len(h), int(g[-1]) + m + slack)
            window = h[a:b]
            if np.isin(own, window).sum() < threshold * m:  # no alignment can score more than its matches
                continue
            s, first, last = align(own, window)
            s /= MATCH * m
            if s >= threshold and (best is None or s > best[1]):
                best = (k, s, a + first, a + last, len(g))
        if best:
            out.append(best)
    return out


def _leaks(shared, threshold: float):
    def run(batches):
        seeds = shared.value
        for b in batches:
            rows = []
            ids, texts = lists(b, "doc_id", "text")
            for i, h in zip(ids, hashes(texts)):
                rows += [(i, seeds.ids[k], s, a, e, n) for k, s, a, e, n in leaks(seeds, h, threshold)]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])

    return run


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, n: int):
    """The seeds of each block of test items."""
    items = benchmark.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).filter(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Seeds([(r[0], r[1]) for r in block.orderBy("item_id", "text").toLocalIterator()], n)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 3, threshold: float = 0.5) -> DataFrame:
    """One row per (document, test item) that aligns: doc_id, item_id, score, start_word, end_word, n_seeds."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for seeds in _blocks(benchmark, item_id_col, item_text_col, n):
        found = d.mapInArrow(_leaks(docs.sparkSession.sparkContext.broadcast(seeds), threshold), "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long")
        out = found if out is None else out.unionByName(found)
    return out


def _without(shared, threshold: float, at: int):
    def run(batches):
        seeds = shared.value
        for b in batches:
            clean = [not leaks(seeds, h, threshold) for h in hashes(b.column(at).to_pylist())]
            yield b.filter(pa.array(clean, pa.bool_()))

    return run


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 3, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with which no test item aligns, with all their columns."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    at = names.index(text_col)
    for seeds in _blocks(benchmark, item_id_col, item_text_col, n):
        inner = inner.mapInArrow(_without(docs.sparkSession.sparkContext.broadcast(seeds), threshold, at), kinds)
    return inner.toDF(*names)
