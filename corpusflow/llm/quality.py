"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (consecutive blocks of its UTF-8 bytes, all of
them). A passage is described by transitions between character classes and by how
concentrated its n-grams are; a learned layer encodes it. Gated attention weights
(tanh times sigmoid, softmax over the document) combine the encodings, and a
logistic layer scores the weighted passage representation. Only document labels
train it.

The fit uses at most ``max_train`` labelled documents (those of the least id
hash) and ``FIT_PASSAGES`` passages of each; scoring reads every whole text, in
batches, with the small weights only.

Defined cases: a null or empty text is one passage without features and gets a
score like any other; null labels aren't learned from; labels of one class alone
give that class's rate to all; rows with equal ids are scored each on their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import lists, record

PASSAGE = 512
CLASSES = 16
GRAM_BINS = 1024
FEATURES = CLASSES * CLASSES + 4
PIECE = PASSAGE << 12
FIT_PASSAGES = 256  # of a document, in the fit
BLOCK_BYTES = 1 << 18  # small enough for the arrays of a block to stay in the cache


def _classes() -> np.ndarray:
    t = np.full(256, 15, np.uint8)
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    for i, chars in enumerate((b" \t", b"\n\r\x0b\x0c", b".", b",", b"!?", b"%", b"$", b"&*#@", b"|", b"\"'`", b"()[]{}<>", b";:-_/\\+=~^")):
        for c in chars:
            t[c] = 3 + i
    return t


CLASS = _classes()


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text); long texts go piece by piece."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if max(map(len, raw), default=0) <= PIECE:
        return _passages(raw)
    xs, ns = [], []
    for b in raw:
        parts = [_passages([b[k : k + PIECE]]) for k in range(0, len(b) or 1, PIECE)]
        xs += [x for x, _ in parts]
        ns.append(sum(int(n[0]) for _, n in parts))
    return np.concatenate(xs), np.array(ns, np.int64)


def _passages(bs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(b) for b in bs], np.int64)
    n = np.maximum(1, -(-size // PASSAGE))
    total = int(n.sum())
    buf = np.frombuffer(b"".join(bs), np.uint8)
    x = np.zeros((total, FEATURES), np.float32)
    if not len(buf):
        return x, n
    first = np.r_[0, np.cumsum(n)[:-1]]
    length = np.full(total, PASSAGE, np.int64)
    length[first + n - 1] = size - (n - 1) * PASSAGE
    pid = np.repeat(np.arange(total, dtype=np.int32), length)
    cls = CLASS[buf]
    pair = (cls[:-1] << 4) | cls[1:]
    inside = pid[:-1] == pid[1:]
    x[:, : CLASSES * CLASSES] = np.bincount(((pid[:-1] << 8) | pair)[inside], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    if len(buf) > 3:
        whole = np.flatnonzero(pid[3:] == pid[:-3])
        b = np.ascontiguousarray(buf).astype(np.uint32)
        four = b[:-3] | (b[1:-2] << 8) | (b[2:-1] << 16) | (b[3:] << 24)
        gram = ((four * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int32)
        count = np.bincount(((pid[:-3] << 10) | gram)[whole], minlength=total * GRAM_BINS).reshape(total, GRAM_BINS).astype(np.float32)
        x[:, -4] = np.einsum("ij,ij->i", count, count)
        x[:, -3] = (count > 0).sum(axis=1)
    k = np.maximum(1, length)[:, None].astype(np.float32)
    x[:, : CLASSES * CLASSES] = np.sqrt(x[:, : CLASSES * CLASSES] / k)
    x[:, -4] = np.sqrt(x[:, -4]) / k[:, 0]
    x[:, -3] /= k[:, 0]
    x[:, -2] = length / PASSAGE
    x[:, -1] = 1
    return x, n


class GatedAttention:
    """h = tanh(x W); a = softmax(w . (tanh(h V) * sigmoid(h U))); p = sigmoid(z . sum(a h) + c)."""

    def __init__(self, features: int = FEATURES, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "W": r.normal(0, 1 / 8, (features, hidden)), "V": r.normal(0, 0.3, (hidden, gate)), "U": r.normal(0, 0.3, (hidden, gate)),
            "w": r.normal(0, 0.3, gate), "z": r.normal(0, 0.3, hidden), "c": np.zeros(1),
        }

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        start = np.r_[0, np.cumsum(n)[:-1]]
        doc = np.repeat(np.arange(len(n)), n)
        h = np.tanh(x @ p["W"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, start)[doc])
        a = e / np.add.reduceat(e, start)[doc]
        bag = np.add.reduceat(a[:, None] * h, start)
        y = 1 / (1 + np.exp(-np.clip(bag @ p["z"] + p["c"][0], -30, 30)))
        return {"doc": doc, "start": start, "h": h, "t": t, "s": s, "a": a, "bag": bag, "y": y}

    def gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, n)
        d = (f["y"] - y) / len(y)
        h, a, doc = f["h"], f["a"], f["doc"]
        dbag = d[:, None] * p["z"]
        da = (dbag[doc] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, f["start"])[doc])
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = a[:, None] * dbag[doc] + dt @ p["V"].T + ds @ p["U"].T
        return {"W": x.T @ (dh * (1 - h**2)), "V": h.T @ dt, "U": h.T @ ds, "w": (f["t"] * f["s"]).T @ de, "z": f["bag"].T @ d, "c": np.array([d.sum()])}

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 0.01, decay: float = 1e-5, seed: int = 11) -> GatedAttention:
        r = np.random.default_rng(seed)
        start = np.r_[0, np.cumsum(n)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            o = r.permutation(len(n))
            lr = rate * (1 - epoch / epochs) + 1e-4
            for k in range(0, len(o), batch):
                ds = o[k : k + batch]
                rows = np.concatenate([np.arange(start[d], start[d + 1]) for d in ds])
                g = self.gradient(x[rows], n[ds], y[ds])
                step += 1
                for q in self.p:
                    gq = g[q] + decay * self.p[q]
                    m[q] = 0.9 * m[q] + 0.1 * gq
                    v[q] = 0.999 * v[q] + 0.001 * gq**2
                    self.p[q] -= lr * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, ys = lists(b, "doc_id", "text", "y")
        for i, t, y in zip(ids, texts, ys):
            x, n = passages([t])
            if len(x) > FIT_PASSAGES:  # evenly spread ones; scores always see all
                x = x[np.linspace(0, len(x) - 1, FIT_PASSAGES).astype(int)]
                n = np.array([FIT_PASSAGES])
            yield record(doc_id=([i], pa.int64()), y=([y], pa.int32()), n=(n, pa.int64()), x=([x.astype(np.float16).tobytes()], pa.binary()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 3000) -> GatedAttention | float:
    """Fit on labelled documents that aren't held out; a number if there is one class alone."""
    ys = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    ys = ys.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = ys.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # the documented bound of the fit
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = d.join(F.broadcast(sample), "doc_id").mapInArrow(_describe, "doc_id long, y int, n long, x binary")
    got = sorted(rows.toLocalIterator(), key=lambda r: (r["doc_id"], r["n"]))
    y = np.array([r["y"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.concatenate([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in got]).astype(np.float64)
    return GatedAttention().fit(x, np.array([r["n"] for r in got]), y)


def _score(model: GatedAttention | float):
    def scores(texts: list[str | None]) -> list[float]:
        if isinstance(model, float):
            return [model] * len(texts)
        x, n = passages(texts)
        return model.forward(x, n)["y"].tolist()

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            out, block, size = [], [], 0
            for t in texts:
                block.append(t)
                size += len(t or "")
                if size >= BLOCK_BYTES:
                    out += scores(block)
                    block, size = [], 0
            if block:
                out += scores(block)
            at = b.schema.get_field_index("text")
            cols, names = list(b.columns), list(b.schema.names)
            cols[at], names[at] = pa.array(out, pa.float64()), "score"
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def score(docs: DataFrame, model: GatedAttention | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(_score(model), "doc_id long, score double")


def keep_good(docs: DataFrame, model: GatedAttention | float, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{names.index(text_col)}"))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return inner.mapInArrow(_score(model), f"{kinds}, score double").filter(F.col("score") >= threshold).drop("score").toDF(*names)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(docs, train(docs, labels, max_train=max_train))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


__all__ = ["GatedAttention", "classify", "held_out", "is_held_out", "keep_good", "passages", "score", "train"]
