"""Line dedup by a sharded minimal perfect hash.

Lines that many documents hold go everywhere but in the largest doc_id holding
them. Blocks of documents lie in files in the shared folder (``blocks``); a block
sends each distinct line hash (128 bits) once, with how many of its documents hold
the line and the largest doc_id. A shard builds a minimal perfect hash over its
distinct line hashes, which indexes a compact fingerprint array, a count array and
a keeper array; the blocks' entries probe the index to fill counts and keepers, and
probe it again for their answers: at the probe the count decides. The answers meet
by block, where the documents are; no line is joined and no text shuffled. A shard's
index is made and probed in one task, whatever the number of shards, and a line that
a third of all documents hold is one entry a block.

Defined cases: a null or empty text is one empty line; each row is a document of
its own, also when rows repeat; a row with a null id never counts as holding a
line and keeps its lines; extra columns are ignored. ``docs`` should be a scan of
files or another source that gives equal rows in equal order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import blocks, mph
from corpusflow.llm.common import U64, record, shared_path

WHITE = "\x20\t\n\x0b\x0c\r"
SENT = "shard int, block long, h1 binary, h2 binary, times binary, keepers binary"
REPLY = "block long, shard int, hot binary, keepers binary"


def line_keys(text: str | None, min_chars: int) -> tuple[list[str], list[tuple[int, bytes]]]:
    """The lines of a text and (line number, 128-bit key hash) of those long enough."""
    ls = (text or "").split("\n")
    out = []
    for i, line in enumerate(ls):
        if len(line) >= min_chars:
            s = line.strip(WHITE)
            if len(s) >= min_chars:
                out.append((i, xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass").lower())))
    return ls, out


def _keys(ids: list[int | None], texts: list[str | None], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, 128-bit hash) of the lines long enough, of rows with an id."""
    row, line, keys = [], [], []
    for k, (i, t) in enumerate(zip(ids, texts)):
        if i is not None and t and len(t) >= min_chars:
            own = line_keys(t, min_chars)[1]
            row += [k] * len(own)
            line += [x for x, _ in own]
            keys += [x for _, x in own]
    return np.array(row, np.int32), np.array(line, np.int32), np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _first(path: str, shards: int, min_chars: int, block_words: int):
    def run(batches):
        for block, table in blocks.cut_tables(batches, "text", block_words):
            blocks.write(path, f"{block}.rows", table, "zstd")
            ids = table["doc_id"].to_pylist()
            row, line, h = _keys(ids, table["text"].to_pylist(), min_chars)
            shard = ((h[:, 1] >> U64(40)) % U64(shards)).astype(np.int32)
            o = np.lexsort((row, h[:, 1], h[:, 0], shard))
            h, own, shard = h[o], row[o], shard[o]
            new = np.r_[True, (h[1:] != h[:-1]).any(axis=1)] if len(o) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            place = np.empty(len(o), np.int32)
            place[o] = np.cumsum(new) - 1
            blocks.write(path, f"{block}.lines", pa.table({"row": row, "line": line, "place": place}), "zstd")
            times = np.add.reduceat(new | np.r_[True, own[1:] != own[:-1]], first, dtype=np.int64) if len(o) else np.zeros(0, np.int64)
            keeper = np.maximum.reduceat(np.array([ids[k] for k in own], np.int64), first) if len(o) else np.zeros(0, np.int64)
            h, shard = h[first], shard[first]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            used = [k for k in range(shards) if cuts[k] < cuts[k + 1]]
            part = lambda a, kind: (pa.array([a[cuts[k] : cuts[k + 1]].astype(kind).tobytes() for k in used] + [None], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*used, block % shards], pa.int32()), pa.array([block] * (len(used) + 1), pa.int64()), part(h[:, 0], "<u8"), part(h[:, 1], "<u8"), part(times, "<u4"), part(keeper, "<i8")],
                names=["shard", "block", "h1", "h2", "times", "keepers"])

    return run


class LineIndex:
    """A minimal perfect hash over distinct line hashes, with fingerprint, count and keeper arrays."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        o = np.lexsort((h2, h1))
        a, b = h1[o], h2[o]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(o) else np.zeros(0, bool)
        a, b = a[new], b[new]
        self.f = mph.build(a, b)
        at = mph.lookup(self.f, a, b)
        self.fp = np.zeros(len(a), np.uint32)
        self.fp[at] = self._print(a, b)
        self.count, self.keeper = np.zeros(len(a), np.int64), np.full(len(a), np.iinfo(np.int64).min)

    @staticmethod
    def _print(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return ((h1 ^ (h2 >> U64(7))) & U64(0xFFFFFFFF)).astype(np.uint32)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each hash's index, or -1."""
        at = mph.lookup(self.f, h1, h2)
        return np.where((at >= 0) & (self.fp[np.maximum(at, 0)] == self._print(h1, h2)), at, -1) if len(self.fp) else np.full(len(h1), -1)

    def add(self, at: np.ndarray, times: np.ndarray, keepers: np.ndarray) -> None:
        np.add.at(self.count, at, times)
        np.maximum.at(self.keeper, at, keepers)


def _probe(min_docs: int):
    def run(table: pa.Table) -> pa.Table:
        named = table.filter(pa.compute.is_null(table["h1"]))
        rows = table.filter(pa.compute.is_valid(table["h1"]))
        hot, keepers = [], []
        if rows.num_rows:
            h1, h2, times, best = (np.frombuffer(b"".join(rows[c].to_pylist()), k) for c, k in (("h1", "<u8"), ("h2", "<u8"), ("times", "<u4"), ("keepers", "<i8")))
            index = LineIndex(h1, h2)
            at = index.find(h1, h2)
            index.add(at, times, best)
            ends = np.cumsum([len(x) // 8 for x in rows["h1"].to_pylist()])[:-1]
            for part in np.split(at, ends):
                on = index.count[part] >= min_docs
                hot.append(on.astype(np.uint8).tobytes())
                keepers.append(index.keeper[part[on]].astype("<i8").tobytes())
        more = [None] * named.num_rows
        return pa.table({"block": pa.array(rows["block"].to_pylist() + named["block"].to_pylist(), pa.int64()), "shard": pa.array(rows["shard"].to_pylist() + [-1] * len(more), pa.int32()),
                         "hot": pa.array(hot + more, pa.binary()), "keepers": pa.array(keepers + more, pa.binary())})

    return run


def _drop(path: str, with_text: bool):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        replies = sorted(r for r in zip(table["shard"].to_pylist(), table["hot"].to_pylist(), table["keepers"].to_pylist()) if r[1] is not None)
        hot = np.frombuffer(b"".join(r[1] for r in replies), np.uint8) > 0
        keeper = np.zeros(len(hot), np.int64)
        keeper[hot] = np.frombuffer(b"".join(r[2] for r in replies), "<i8")
        docs, lines = blocks.read(path, f"{block}.rows"), blocks.read(path, f"{block}.lines")
        ids, texts = docs["doc_id"].to_pylist(), docs["text"].to_pylist()
        row, line, place = (lines[c].to_numpy() for c in ("row", "line", "place"))
        gone: dict[int, set[int]] = {}
        for k in np.flatnonzero(hot[place]).tolist():
            if keeper[place[k]] != ids[row[k]]:
                gone.setdefault(int(row[k]), set()).add(int(line[k]))
        n = [(t or "").count("\n") + 1 for t in texts]
        kept = [t or "" for t in texts]
        for k, g in gone.items():
            kept[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in g)
        if with_text:
            last = {"kept": (kept, pa.string())}
        else:
            last = {"kept_sha256": ([hashlib.sha256(k.encode("utf-8", "surrogatepass")).hexdigest() for k in kept], pa.string())}
        more = record(n_lines=(n, pa.int64()), n_dropped=([len(gone.get(k, ())) for k in range(len(ids))], pa.int64()), **last)
        names = [c for c in docs.column_names if c != "text"]
        return pa.table([*(docs[c] for c in names), *more.columns], names=[*names, *more.schema.names])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40, keep: tuple[str, ...] = (), digest: bool = False, block_words: int = blocks.BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, the columns in ``keep``, n_lines, n_dropped and the kept text.

    With ``digest`` the kept text is replaced by its SHA-256 (``kept_sha256``).
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)])
    kinds = "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    shards, parts = blocks.plan_sizes(blocks.input_bytes(rows, F.col("text")), block_words)
    path = shared_path(docs.sparkSession, "lines")
    sent = rows.mapInArrow(_first(path, shards, min_chars, block_words), SENT)
    replies = blocks.by_shard(sent, shards).applyInArrow(blocks.lean(_probe(min_docs)), REPLY)
    out = blocks.by_block(replies, parts).applyInArrow(blocks.lean(_drop(path, not digest)), f"doc_id long{kinds}, n_lines long, n_dropped long, {'kept_sha256' if digest else 'kept'} string")
    return out.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})
