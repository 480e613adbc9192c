"""A minimal perfect hash over 128-bit keys, as numpy arrays, with a file format.

Level by level each key hashes into a bit array of twice as many bits as keys
left; keys alone on their bit stay there, the others go to the next level. The
rank of a key's bit is its index, so n keys get the indices 0 to n-1.
"""

from __future__ import annotations

import io

import numpy as np

from corpusflow.llm.common import GOLD, U64, mix

GAMMA = 2
LEVELS = 48


def _key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1 ^ mix(h2))


def _position(k: np.ndarray, level: int, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(k + GOLD * U64(level + 1)) % U64(m)


def build(h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """Level sizes, bits and ranks; keys that no level could place are in ``left``."""
    k = _key(h1, h2)
    sizes, parts = [], []
    for level in range(LEVELS):
        if not len(k):
            break
        m = -(-max(64, GAMMA * len(k)) // 64) * 64
        p = _position(k, level, m)
        alone = np.bincount(p.astype(np.int64), minlength=m) == 1
        parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(m)
        k = k[~alone[p.astype(np.int64)]]
    bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))]).astype(np.uint32)
    return {"sizes": np.array(sizes, np.int64), "bits": bits, "rank": rank, "left": np.unique(k)}


def lookup(f: dict[str, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's index, or -1. A key that wasn't built in may get any index: compare fingerprints."""
    k = _key(h1, h2)
    out = np.full(len(k), -1, np.int64)
    todo = np.arange(len(k))
    start = 0
    for level, m in enumerate(f["sizes"].tolist()):
        if not len(todo):
            break
        p = _position(k[todo], level, m).astype(np.int64) + start
        word, bit = p >> 6, (p & 63).astype(np.uint64)
        on = (f["bits"][word] >> bit) & U64(1) == 1
        below = np.bitwise_count(f["bits"][word[on]] & ((U64(1) << bit[on]) - U64(1)))
        out[todo[on]] = f["rank"][word[on]].astype(np.int64) + below
        todo = todo[~on]
        start += m
    if len(todo) and len(f["left"]):
        i = np.searchsorted(f["left"], k[todo])
        hit = (i < len(f["left"])) & (f["left"][np.minimum(i, len(f["left"]) - 1)] == k[todo])
        out[todo[hit]] = int(f["rank"][-1]) + i[hit]
    return out


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    return buf.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}
