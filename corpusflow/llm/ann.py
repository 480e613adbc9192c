"""Approximate nearest neighbours by collision-counting hashing.

Each shard of vectors keeps, for every random projection, the projected values in
sorted order. A query opens a window round its own projection in every array and
counts, per vector, the arrays in which it lies inside; vectors whose count reaches
the collision threshold are verified by the inner product, in single precision
first and exactly where that decides. Virtual rehashing
widens all windows together (the parts added are counted, nothing is recounted)
until k verified vectors lie within the radius, or everything was seen.

The largest inner product becomes the least distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm; the query's own is zero and its norm
is scaled to M.

Every valid vector is indexed and every query meets every shard: query blocks of
bounded size against shards of bounded size, merged per query.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, also as queries; vectors of different lengths aren't compared, each
length has its own shards; rows with the query's id are its own; ties go to the
smaller id; with fewer than k candidates all are returned; repeated ids are repeated
candidates, and as queries each row has its own list; an empty table gives no row.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import filesystem, record, shared_path, shuffle_partitions

SHARD_ROWS = 65_536
BLOCK_QUERIES = 128
PROJECTIONS = 24
HALF_WIDTH = 0.7  # of the radius
INSIDE = 0.5161  # chance that a vector at the radius collides: P(|N(0,1)| <= HALF_WIDTH)
SIGMAS = 1.4
START, STEP = 0.9, 1.2
SLACK = 1e-4  # far above what single precision is off by for vectors of norm 1 at most
_OPEN: dict[str, dict] = {}


def projections(dim: int, m: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim + 1, m)).astype(np.float32)


def build(ids: np.ndarray, x: np.ndarray, top: float, m: int = PROJECTIONS) -> dict[str, np.ndarray]:
    """The sorted arrays of a shard; vectors are scaled by the largest norm."""
    y = x / top
    extra = np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))
    p = np.c_[y, extra].astype(np.float32) @ projections(x.shape[1], m)
    order = np.argsort(p, axis=0, kind="stable").T.astype(np.intp).copy()
    return {"ids": ids, "x": x, "near": (x / top).astype(np.float32), "order": order, "sorted": np.take_along_axis(p.T, order, axis=1).copy()}


def search(shard: dict[str, np.ndarray], own: int, q: np.ndarray, k: int, products: np.ndarray | None = None) -> list[tuple[int, float]]:
    """The k largest inner products found: (id, product), the query's own id apart.

    ``products`` are the shard's with the query's unit vector, in single precision; a block of queries
    has them by one matrix product, which costs less than gathering the vectors that pass.
    """
    ids, x, order, values = shard["ids"], shard["x"], shard["order"], shard["sorted"]
    n, m = len(ids), len(order)
    unit = q / np.linalg.norm(q)
    at = np.r_[unit, 0].astype(np.float32) @ projections(len(q), m)
    need = int(np.ceil(m * INSIDE - SIGMAS * np.sqrt(m * INSIDE * (1 - INSIDE))))
    counts = np.zeros(n, np.intp)
    seen = ids == own
    lo = np.array([np.searchsorted(values[j], at[j]) for j in range(m)])
    hi = lo.copy()
    got, near = [np.zeros(0, np.intp)], [np.zeros(0, np.float32)]
    products = shard["near"] @ unit.astype(np.float32) if products is None else products
    radius = START
    while True:
        new = []
        for j in range(m):
            a, b = np.searchsorted(values[j], (at[j] - HALF_WIDTH * radius, at[j] + HALF_WIDTH * radius))
            if a < lo[j]:
                new.append(order[j, a : lo[j]])
                lo[j] = a
            if b > hi[j]:
                new.append(order[j, hi[j] : b])
                hi[j] = b
        if new:
            counts += np.bincount(np.concatenate(new), minlength=n)
        all_in = bool((hi - lo == n).all())
        fresh = np.flatnonzero((counts >= need) & ~seen) if not all_in else np.flatnonzero(~seen)
        if len(fresh):
            seen[fresh] = True
            got.append(fresh)
            near.append(products[fresh])
        c = np.concatenate(near)
        kth = np.partition(c, len(c) - k)[len(c) - k] if len(c) >= k else -np.inf
        # |x' - q'|^2 = 2 - 2 x.q / (M |q|)
        if all_in or kth >= 1 - radius * radius / 2:
            i = np.concatenate(got)[c >= kth - SLACK]  # in single precision by then; the rest is exact
            s = x[i] @ q
            o = np.lexsort((ids[i], -s))[:k]
            return [(int(ids[i[j]]), float(s[j])) for j in o]
        radius *= STEP


def _write(path: str):
    def run(table: pa.Table) -> pa.Table:
        dim, k, top = (table[c][0].as_py() for c in ("dim", "shard", "top"))
        x = np.frombuffer(b"".join(table["v"].to_pylist()), "<f8").reshape(-1, dim)
        ids = table["vec_id"].to_numpy()
        o = np.argsort(ids, kind="stable")
        buf = io.BytesIO()
        np.savez(buf, **build(ids[o], x[o], top))
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        tmp = f"{root}/.{dim}-{k}-{np.random.default_rng().integers(1 << 62)}"
        with fs.open_output_stream(tmp) as out:
            out.write(buf.getbuffer())
        fs.move(tmp, f"{root}/{dim}-{k}.npz")  # a second attempt writes the same arrays
        return pa.table({"rows": pa.array([len(ids)], pa.int64())})

    return run


def _open(path: str, dim: int, k: int) -> dict | None:
    name = f"{path}/{dim}-{k}"
    if name not in _OPEN:
        _OPEN.clear()
        fs, root = filesystem(path)
        if fs.get_file_info(f"{root}/{dim}-{k}.npz").type == pafs.FileType.NotFound:
            return None
        with fs.open_input_file(f"{root}/{dim}-{k}.npz") as f, np.load(io.BytesIO(f.read())) as z:
            _OPEN[name] = {a: z[a] for a in z.files}
    return _OPEN[name]


def _search(path: str, k: int):
    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        shard = _open(path, dim, table["shard"][0].as_py())
        rows = []
        if shard is not None:
            q = np.frombuffer(b"".join(table["v"].to_pylist()), "<f8").reshape(-1, dim)
            unit = (q / np.linalg.norm(q, axis=1)[:, None]).astype(np.float32)
            for c in range(0, len(q), BLOCK_QUERIES):
                products = unit[c : c + BLOCK_QUERIES] @ shard["near"].T
                for row, i, v, p in zip(table["row"].to_pylist()[c:], table["vec_id"].to_pylist()[c:], q[c:], products):
                    rows += [(row, i, j, s) for j, s in search(shard, i, v, k, p)]
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.table({"row": pa.array(cols[0], pa.int64()), "query_id": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    return run


def _pack(batches):
    for b in batches:
        x = [np.array(v, "<f8") for v in b.column(1).to_pylist()]
        more = record(v=([v.tobytes() for v in x], pa.binary()), dim=([len(v) for v in x], pa.int32()), norm=([float(np.linalg.norm(v)) for v in x], pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(0), *more.columns, b.column(2), b.column(3)], names=["vec_id", "v", "dim", "norm", "q", "row"])


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where ``is_query``."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("e"), F.coalesce(is_query, F.lit(False)).alias("q"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id())
    packed = v.select("vec_id", "e", "q", "row").mapInArrow(_pack, "vec_id long, v binary, dim int, norm double, q boolean, row long")
    lengths = packed.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.count_if("q").alias("queries"))
    each = [(r["dim"], -(-r["n"] // shard_rows), r["top"], max(1, -(-r["queries"] // BLOCK_QUERIES))) for r in lengths.collect()]  # one row a length of vectors
    if not each:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    packed = packed.join(spark.createDataFrame(each, "dim int, shards long, top double, blocks long"), "dim")
    path = shared_path(spark, "ann")
    packed.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), "shards")).select("vec_id", "v", "dim", "top", "shard").groupBy("dim", "shard").applyInArrow(_write(path), "rows long").agg(F.sum("rows")).collect()
    blocked = packed.filter("q").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    # a stated number of partitions, since these few bytes are much work and would be coalesced into one task
    spread = blocked.select("row", "vec_id", "v", "dim", "shard", "block").repartition(min(sum(s * b for _, s, _, b in each), 4 * shuffle_partitions(spark)), "dim", "shard", "block")
    found = spread.groupBy("dim", "shard", "block").applyInArrow(_search(path, k), "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
