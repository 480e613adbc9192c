"""Texts as one array of code points, for measures that numpy takes of many texts at once."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

END = 0x110000  # stands behind each text; no character
# classes of characters, as the patterns in functions/text.py have them
LETTER, NUMBER, DIGIT, WORDCHAR, BLANK, LOWER, UPPER, LINEEND, PLAIN = (1 << k for k in range(9))


@cache
def classes() -> np.ndarray:
    """The classes of each code point."""
    kinds = np.array([unicodedata.category(chr(c)) for c in range(END)])
    first = kinds.astype("U1")
    out = np.zeros(END + 1, np.uint16)
    own = out[:END]
    own[first == "L"] |= LETTER | WORDCHAR
    own[first == "N"] |= NUMBER | WORDCHAR
    own[kinds == "Nd"] |= DIGIT
    own[ord("_")] |= WORDCHAR
    blank = first == "Z"
    own[~blank & ((own & WORDCHAR) == 0)] |= PLAIN
    own[[9, 10, 11, 12, 13]] &= ~np.uint16(PLAIN)
    blank[[9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = True
    own[blank] |= BLANK
    own[[10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]] |= LINEEND
    own[ord("a") : ord("z") + 1] |= LOWER
    own[ord("A") : ord("Z") + 1] |= UPPER
    out[END] = BLANK
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of all texts, each followed by END; the places of END)."""
    c = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    c[ends] = END
    return c, ends


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    return edge[::2], edge[1::2]


def before(mask: np.ndarray) -> np.ndarray:
    """How many true values there are before each place and before the end."""
    return np.r_[np.int64(0), np.cumsum(mask)]


MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of an odd number and of its inverse, modulo 2^64."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(1 << 18, n)
    a, b = (np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    if n <= 1 << 20:  # those of a very long text aren't kept
        _powers[:] = a, b
    return a, b


def prefix_hashes(c: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums whose differences, times the inverse power of the first place, are hashes of what lies between."""
    own = c.astype(np.uint64)
    own = (own + np.uint64(1)) * MIX
    own ^= own >> np.uint64(29)
    own *= power[: len(c)]
    return np.r_[np.uint64(0), np.cumsum(own, dtype=np.uint64)]
