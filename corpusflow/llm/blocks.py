"""Blocks of documents kept in the shared folder, and the tally of what several blocks hold.

A mapper cuts its partition into blocks of bounded size and writes each block's
data as one file. Of the block's tokens (hashes of shingles or windows) only the
distinct ones travel: three bytes each, a cell of a shard, with how many of the
block's documents hold it. A shard adds these numbers up and replies with one byte
a token, the binary logarithm of the sum. Replies meet again by block, where the
block's file is read, so neither texts nor positions are ever shuffled, and a token
that a third of all documents hold is one entry a block.

Two tokens may share a cell; a tally is then too large, never too small. Block
numbers come from the partition and the order in it, so a task that runs again
writes the same files, if the source gives equal rows in equal order (a scan of
files does).
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import U64, filesystem

CELL_BITS = 24
SHARD_TOKENS = 3_000_000  # of the 16.8 million cells of a shard
BLOCK_WORDS = 500_000
BLOCK_DOCS = 60_000  # below 2^16: a document's number in its block has 16 bits
BYTES_A_WORD = 6
MESSAGE = "shard int, block long, low binary, high binary, times binary"
REPLY = "block long, shard int, ranks binary"
_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back to the machine: workers live on between tasks, more of them than run at a time."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def lean(run):
    """A function of a group that leaves no freed memory with its worker."""

    @functools.wraps(run)
    def call(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            trim()

    return call


def input_bytes(df: DataFrame, text: Column) -> int:
    """The size of what ``df`` reads: by the files' sizes, or where a source doesn't know its size, by counting."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if all(s < 1 << 55 for s in sizes):
        return sum(sizes)
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def plan_sizes(size: int, block_words: int = BLOCK_WORDS) -> tuple[int, int]:
    """(shards, partitions for work by block), both in proportion to the input."""
    words = 2 * size // BYTES_A_WORD  # files are compressed, some to half
    return max(8, -(-words // SHARD_TOKENS)), max(16, min(100_000, -(-words // block_words)))


def cut(batches, names: list[str], block_words: int, block_docs: int = BLOCK_DOCS):
    """(block number, rows) of a partition; a row is a tuple of the named columns, the text last."""
    first = TaskContext.get().partitionId() if TaskContext.get() else 0
    held, size, k = [], 0, 0
    for b in batches:
        for row in zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names]):
            held.append(row)
            size += len(row[-1] or "") // BYTES_A_WORD + 1
            if size >= block_words or len(held) >= block_docs:
                yield first << 20 | k, held
                held, size, k = [], 0, k + 1
                trim()
    if held:
        yield first << 20 | k, held
    held = []
    trim()


def cut_tables(batches, text: str, block_words: int, block_docs: int = BLOCK_DOCS):
    """As ``cut``, with all columns as an Arrow table."""
    first = TaskContext.get().partitionId() if TaskContext.get() else 0
    held, size, docs, k = [], 0, 0, 0
    for b in batches:
        words = pa.compute.fill_null(pa.compute.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(False) // BYTES_A_WORD + 1
        at = 0
        while at < b.num_rows:
            n = max(1, min(int(np.searchsorted(np.cumsum(words[at:]), block_words - size)) + 1, b.num_rows - at, block_docs - docs))
            held.append(b.slice(at, n))
            size, docs, at = size + int(words[at : at + n].sum()), docs + n, at + n
            if size >= block_words or docs >= block_docs:
                yield first << 20 | k, pa.Table.from_batches(held)
                held, size, docs, k = [], 0, 0, k + 1
                trim()
    if held:
        yield first << 20 | k, pa.Table.from_batches(held)
    held = []
    trim()


def write(path: str, name: str, table: pa.Table, compression: str | None = None) -> None:
    """One Arrow file, in place as a whole or not at all."""
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    tmp = f"{root}/.{name}-{np.random.default_rng().integers(1 << 62)}"
    with fs.open_output_stream(tmp) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as w:
        w.write_table(table)
    fs.move(tmp, f"{root}/{name}")  # a second attempt writes the same bytes


def read(path: str, name: str) -> pa.Table:
    fs, root = filesystem(path)
    with fs.open_input_file(f"{root}/{name}") as f:
        return pa.ipc.open_file(f).read_all()


def cells(tokens: np.ndarray, shards: int) -> np.ndarray:
    """Shard and cell of each token, as one number that sorts by shard."""
    return ((tokens >> U64(40)) % U64(shards)) << U64(CELL_BITS) | (tokens & U64((1 << CELL_BITS) - 1))


def message(block: int, distinct: np.ndarray, times: np.ndarray, shards: int) -> pa.RecordBatch:
    """A block's distinct cells, sorted, for the tally: one row a shard, and one that only names the block."""
    shard = (distinct >> U64(CELL_BITS)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    used = [k for k in range(shards) if cuts[k] < cuts[k + 1]]
    low, high = (distinct & U64(0xFFFF)).astype("<u2"), ((distinct >> U64(16)) & U64(0xFF)).astype(np.uint8)
    times = np.minimum(times, 255).astype(np.uint8)
    part = lambda a: pa.array([a[cuts[k] : cuts[k + 1]].tobytes() for k in used] + [None], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([*used, block % shards], pa.int32()), pa.array([block] * (len(used) + 1), pa.int64()), part(low), part(high), part(times)], names=["shard", "block", "low", "high", "times"])


def _tally(table: pa.Table) -> pa.Table:
    named = table.filter(pa.compute.is_null(table["low"]))
    rows = table.filter(pa.compute.is_valid(table["low"]))
    low = [np.frombuffer(x, "<u2") for x in rows["low"].to_pylist()]
    replies = []
    if low:
        high, times = (np.frombuffer(b"".join(rows[c].to_pylist()), np.uint8) for c in ("high", "times"))
        cell = np.concatenate(low).astype(np.uint32) | high.astype(np.uint32) << 16
        o = np.argsort(cell)
        new = np.r_[True, cell[o][1:] != cell[o][:-1]]
        df = np.add.reduceat(times[o], np.flatnonzero(new), dtype=np.int64)
        rank = np.empty(len(o), np.uint8)
        rank[o] = np.log2(df).astype(np.uint8)[np.cumsum(new) - 1]
        replies = [r.tobytes() for r in np.split(rank, np.cumsum([len(x) for x in low])[:-1])]
    block = rows["block"].to_pylist() + named["block"].to_pylist()
    return pa.table({"block": pa.array(block, pa.int64()), "shard": pa.array(rows["shard"].to_pylist() + [-1] * named.num_rows, pa.int32()), "ranks": pa.array(replies + [None] * named.num_rows, pa.binary())})


def by_shard(df: DataFrame, shards: int, name: str = "shard"):
    """Grouped by shard, each shard in a partition of its own."""
    return df.repartitionById(shards, F.col(name)).groupBy(name)


def by_block(df: DataFrame, partitions: int):
    """Grouped by block, the blocks of a partition spread over others."""
    slot = F.pmod(F.shiftright("block", 20) * 31 + F.col("block").bitwiseAND((1 << 20) - 1), F.lit(partitions)).cast("int")
    return df.withColumn("slot", slot).repartitionById(partitions, F.col("slot")).groupBy("slot", "block")


def tally(messages: DataFrame, shards: int, partitions: int):
    """The replies, grouped by block."""
    return by_block(by_shard(messages, shards).applyInArrow(lean(_tally), REPLY), partitions)


def places(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted cells, how often each stands there, and each cell's place among them."""
    o = np.argsort(cell)
    new = np.r_[True, cell[o][1:] != cell[o][:-1]] if len(cell) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.empty(len(cell), np.int64)
    place[o] = np.cumsum(new) - 1
    return cell[o][first], np.diff(np.r_[first, len(cell)]), place


def ranks(table: pa.Table) -> np.ndarray:
    """A block's replies in the order of its sorted distinct cells."""
    rows = sorted((s, r) for s, r in zip(table["shard"].to_pylist(), table["ranks"].to_pylist()) if r is not None)
    return np.frombuffer(b"".join(r for _, r in rows), np.uint8)
