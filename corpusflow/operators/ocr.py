"""OCR metrics, the filter on them, and the segment rate."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import product
from typing import Literal

import numpy as np
import pyarrow as pa
from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import codes
from corpusflow.functions.arrow import text_udf
from corpusflow.functions.fields import helper, with_helpers
from corpusflow.functions.text import NOT_SPACE, split_words
from corpusflow.operators.gopher import _more, _Stats
from corpusflow.plans.base import MapFn, Semantics
from corpusflow.plans.registry import components

SHORT_WORDS = "ab ad am an as at au be by da do du eh ei er es ex go he if im in is it ja je la me my no ob of oh on or so to um up us we wo zu".split()
METRICS = ("spacing_anomaly_ratio", "case_anomaly_ratio", "word_fragment_ratio", "line_artifact_ratio", "special_char_density", "repeated_char_ratio", "numeric_context_errors", "word_length_avg", "word_length_std", "ratio_very_short_words", "ratio_very_long_words")
_PAGE = frozenset(map("".join, product("pP", "aA", "gG", "eE")))
_ODD = [ord("'"), 0xA1, *range(0xA6, 0xAD), *range(0xAE, 0xC0), *range(0x2000, 0x2070), 0x20AC, 0x2122, *range(0x2700, 0x27C0)]


def _of(c: np.ndarray, chars: list[int]) -> np.ndarray:
    """Which code points are among these of at most 16 bits."""
    table = np.zeros(1 << 16, bool)
    table[chars] = True
    return table[np.minimum(c, 0xFFFF)]


def _pairs_apart(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the runs, matches of two characters in each): a match begins at each second place of a run."""
    start, stop = codes.runs(mask)
    return start, (stop - start + 1) // 2


def _repeats(c: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, length) of what the pattern ([^\\n]{2,5})\\1{2,} matches from the left, the longest unit first."""
    usable = (c != 10) & (c != codes.END)
    heap = []
    for k in range(2, 6):
        start, stop = codes.runs((c[:-k] == c[k:]) & usable[:-k] & usable[k:])
        long = stop - start >= 2 * k  # three units
        heap += [(s, -k, e) for s, e in zip(start[long].tolist(), stop[long].tolist())]
    heapq.heapify(heap)
    free = 0
    while heap:
        s, k, e = heapq.heappop(heap)
        if s < free:
            if e - free >= -2 * k:
                heapq.heappush(heap, (free, k, e))
            continue
        size = -k * (1 + (e - s) // -k)
        yield s, size
        free = s + size


def ocr_metrics(texts: list[str], semantics: str = "compat") -> np.ndarray:
    """A row of the eleven metrics for each text; zeros where there is no word."""
    c, ends = codes.code_points(texts)
    kind = codes.classes()[c]
    blank, word, letter, digit, lower, upper = ((kind & x) != 0 for x in (codes.BLANK, codes.WORDCHAR, codes.LETTER, codes.DIGIT, codes.LOWER, codes.UPPER))
    latin = lower | upper
    size = np.diff(np.r_[-1, ends]) - 1

    def per_text(at: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(np.searchsorted(ends, at), n, len(texts)).astype(np.int64)

    start, stop = codes.runs(~blank)
    n = per_text(start)
    span = stop - start
    words, letters, digits = codes.before(word), codes.before(letter), codes.before(digit)
    clean = words[stop] - words[start]  # characters of each word without its other ones
    some = clean > 0
    k, total, squares = per_text(start[some]), per_text(start, clean), per_text(start, clean * clean)
    alpha = per_text(start[letters[stop] - letters[start] == span])

    nxt = lambda mask: np.r_[mask[1:], False]
    latin_digit, digit_latin = latin & nxt(digit), digit & nxt(latin)
    camel = lower & nxt(upper)
    spacing = per_text(*_pairs_apart(camel | latin_digit | digit_latin))
    s, e = codes.runs(c == 32)
    spacing += per_text(s[e - s >= 3])
    edge = np.r_[True, ~word, True]  # whether no word character lies before each place
    space = c == 32
    lone = latin[:-4] & space[1:-3] & latin[2:-2] & space[3:-1] & latin[4:] & edge[: len(c) - 4] & edge[6 : len(c) + 2] if len(c) > 4 else np.zeros(0, bool)
    at = np.flatnonzero(lone)
    if len(at):  # candidates of a chain are two apart, a match takes three of them
        opens = np.flatnonzero(np.r_[True, np.diff(at) != 2])
        spacing += per_text(at[opens], (np.diff(np.r_[opens, len(at)]) + 2) // 3)
    ws, we = codes.runs(word)
    spacing += per_text(ws[we - ws >= 25])

    lowers, uppers, camels = codes.before(lower), codes.before(upper), codes.before(camel)
    n_lower, n_upper = lowers[we] - lowers[ws], uppers[we] - uppers[ws]
    all_latin = n_lower + n_upper == we - ws
    case = per_text(ws[all_latin & (n_upper == 1) & lower[ws]]) + per_text(ws[all_latin & (camels[np.maximum(we - 1, ws)] - camels[ws] > 0)])

    at = np.flatnonzero(word)  # the word characters of clean words, one after another
    first = at[words[start[some & (clean <= 2)]]]
    few = clean[some & (clean <= 2)]
    second = at[np.minimum(words[start[some & (clean <= 2)]] + 1, len(at) - 1)] if len(at) else first
    two = (few == 2) & letter[first] & letter[second]
    code, back = np.unique(c[first[two]].astype(np.int64) << 21 | c[second[two]], return_inverse=True)
    odd = np.array([(chr(x >> 21) + chr(x & 0x1FFFFF)).lower() not in SHORT_WORDS for x in code.tolist()], bool)
    fragments = per_text(first[(few == 1) & letter[first]]) + per_text(first[two][odd[back]] if len(code) else first[:0])

    breaks = (kind & codes.LINEEND) != 0
    bare = breaks & ~((c == 10) & np.r_[False, c[:-1] == 13])  # \r\n is one
    cut = np.flatnonzero(bare | (c == codes.END))
    lines = per_text(cut) - np.r_[False, breaks[:-1]][ends]  # a last line end opens no line
    seen = codes.before(~blank)
    ls = np.r_[0, cut[:-1] + 1]
    full = seen[cut] > seen[ls]
    there = np.flatnonzero(~blank)
    a, z = there[seen[ls[full]]], there[seen[cut[full]] - 1] + 1
    whole = lambda mask: (lambda b: b[z] - b[a] == z - a)(codes.before(mask))
    artifact = (z - a <= 2) | whole((kind & codes.PLAIN) != 0) | whole(digit) | whole(_of(c, [ord(x) for x in "IVXivx"]))
    pages = np.flatnonzero((c[a] | 32) == ord("p"))
    for i in pages[z[pages] - a[pages] > 5].tolist():
        s = int(a[i]) + 4
        if "".join(map(chr, c[s - 4 : s].tolist())) in _PAGE and blank[s]:
            artifact[i] |= digit[there[seen[s]]]  # the line ends in no blank

    ordinal = np.zeros(len(start), bool)
    at = np.flatnonzero((span >= 3) & (digits[stop] - digits[start] == span - 2))
    ordinal[at] = [chr(x | 32) + chr(y | 32) in ("st", "nd", "rd", "th") and max(x, y) < 128 for x, y in zip(c[stop[at] - 2].tolist(), c[stop[at] - 1].tolist())]
    mixed = codes.before(latin_digit | ((c == ord("d")) if semantics == "compat" else digit) & nxt(latin))
    as_, ae = codes.runs(latin)
    inside = as_[(np.r_[False, digit][as_]) & digit[ae]] if len(as_) else as_
    between = np.zeros(len(start), bool)
    between[np.searchsorted(start, inside, "right") - 1] = True
    numeric = per_text(start[(mixed[stop - 1] - mixed[start] > 0) & ~ordinal | between])

    s, e = codes.runs((c[:-1] == c[1:]) & (c[:-1] != 10) & (c[:-1] != codes.END))
    same = e - s >= 3
    repeated = per_text(s[same], (e - s + 1)[same])
    found = np.array(list(_repeats(c)), np.int64).reshape(-1, 2)
    repeated += per_text(found[:, 0], found[:, 1])

    ratio = lambda x, y: x / np.maximum(y, 1)
    capped = lambda x, y: np.minimum(ratio(x, y), 1.0)
    out = np.stack([
        capped(spacing, n), np.where(alpha == 0, 0.0, capped(case, alpha)), capped(fragments, n), capped(per_text(a[artifact]), lines), capped(per_text(np.flatnonzero(_of(c, _ODD))), size),
        capped(repeated, size), capped(numeric, n), np.where(k == 0, np.nan, ratio(total, k)), np.where(k <= 1, 0.0, np.sqrt(np.maximum(k * squares - total * total, 0)) / np.maximum(k, 1)),
        ratio(per_text(start[clean == 1]), k), ratio(per_text(start[clean >= 15]), k),
    ], axis=1)
    out[n == 0] = 0.0
    return out


@components.add("tag", "ocr_quality")
class OCRQuality(MapFn):
    """Eleven metrics of many texts at once. Compat keeps the 'd' that stands for a digit in the numeric pattern."""

    name: str = Field(default="ocr_quality")
    to: str = Field(default="metadata.ocr_quality")
    semantics: Semantics = Field(default="compat")

    def column(self, df: DataFrame) -> Column:
        semantics = self.semantics

        def measure(texts: list[str | None]) -> pa.Array:
            return pa.StructArray.from_arrays([pa.array(x) for x in ocr_metrics([t or "" for t in texts], semantics).T], names=list(METRICS))

        return text_udf(", ".join(f"{m} double" for m in METRICS), lambda: measure)(self.text(df))


@components.add("filter", "ocr_quality")
class OCRQualityFilter(_Stats):
    """Compat keeps the rows that look bad, as the reference does; corrected drops them."""

    name: str = Field(default="ocr_quality")
    on: str = Field(default="metadata.ocr_quality")
    max_spacing_anomaly_ratio: float = Field(default=0.15, ge=0, le=1)
    max_case_anomaly_ratio: float = Field(default=0.10, ge=0, le=1)
    max_word_fragment_ratio: float = Field(default=0.20, ge=0, le=1)
    max_line_artifact_ratio: float = Field(default=0.25, ge=0, le=1)
    max_special_char_density: float = Field(default=0.03, ge=0, le=1)
    max_repeated_char_ratio: float = Field(default=0.05, ge=0, le=1)
    max_numeric_context_errors: float = Field(default=0.08, ge=0, le=1)
    max_avg_length: float = Field(default=9, ge=0)
    min_avg_length: float = Field(default=5, ge=0)
    max_std_length: float = Field(default=5, ge=0)
    min_std_length: float = Field(default=1, ge=0)
    max_ratio_short: float = Field(default=0.1, ge=0)
    max_ratio_long: float = Field(default=0.1, ge=0)
    filter_mode: Literal["any", "maj", "all", "strict", "lenient"] = Field(default="strict", description="How many limits a bad row exceeds")
    semantics: Semantics = Field(default="compat")

    def predicate(self, df: DataFrame) -> Column:
        s = self.stat(df)
        fewer = lambda f, least: (F.coalesce(s(f), F.lit(0.0)) < least)
        hits = [_more(s, m, getattr(self, f"max_{m}")) for m in METRICS[:7]]
        hits += [_more(s, "word_length_avg", self.max_avg_length), fewer("word_length_avg", self.min_avg_length), _more(s, "word_length_std", self.max_std_length)]
        hits.append(_more(s, "word_length_std", self.min_std_length) if self.semantics == "compat" else fewer("word_length_std", self.min_std_length))
        hits += [_more(s, "ratio_very_short_words", self.max_ratio_short), _more(s, "ratio_very_long_words", self.max_ratio_long)]
        total = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
        mode = self.filter_mode
        if self.semantics == "compat" and mode in ("any", "maj"):
            return F.lit(self.if_missing)  # these names hit no branch there
        mode = {"any": "strict", "maj": "lenient"}.get(mode, mode)
        bad = {"strict": total > 0, "lenient": total * 2 >= len(hits), "all": total == len(hits)}[mode]
        return bad if self.semantics == "compat" else ~bad


@components.add("tag", "ocroscope")
class OCRRate(MapFn):
    """A stand-in for a language-identifying OCR rate, marked approximate: the share of lines of which
    less than half the words look like words (letters, with punctuation at the ends); -1 without a line."""

    name: str = Field(default="ocr_rate")
    to: str = Field(default="ocr_quality")
    max_chars: int = Field(default=2**16, gt=0, description="Characters that are looked at")

    def prepare(self, df: DataFrame) -> DataFrame:
        t = F.regexp_replace(F.coalesce(self.text(df), F.lit("")), r"[\x00-\x08\x0b-\x1f]", "")
        lines = F.filter(F.split(F.substring(t, 1, self.max_chars), "\n"), lambda x: x.rlike(NOT_SPACE))
        return with_helpers(df, lines=lines)

    def column(self, df: DataFrame) -> Column:
        lines = helper("lines")
        good = lambda x: F.size(F.filter(split_words(x), lambda w: w.rlike(r"""^["'(„«]*\p{L}{2,20}(?:[-'’]\p{L}+)*[.,;:!?)"'“»]*$""")))
        bad = F.filter(lines, lambda x: good(x) * 2 < F.size(split_words(x)))
        return F.when(F.size(lines) == 0, F.lit(-1.0)).otherwise(F.size(bad) / F.greatest(F.size(lines), F.lit(1)).cast("double"))
