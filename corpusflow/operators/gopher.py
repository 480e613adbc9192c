"""Gopher's quality and repetition metrics, and the filters on them."""

from __future__ import annotations

import re
from collections import Counter
from typing import Literal

import numpy as np
import pyarrow as pa
from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import codes
from corpusflow.functions.arrow import text_udf
from corpusflow.functions.fields import field_type, get_field, helper, with_helpers
from corpusflow.functions.text import ASCII_PUNCT, LINE_END, SPACE, count_plain, lines_of, ratio, split_plain
from corpusflow.plans.base import FilterFn, MapFn, Semantics
from corpusflow.plans.registry import components

STOP_WORDS = {
    "en": frozenset("and be have of that the to with".split()),
    "de": frozenset(
        """aber alle als also am an andere auch auf bei beim da dann das dass dem den der des dich die doch dort du durch ein eine einem einen einer einige er es etwa
        für ganz gar gegen haben hat heute hier ich ihr ihren ihrer im in ins ist ja jede jeden jeder jetzt kann könnte mal mehr mich mit muss nach nein nicht noch nun nur
        oder ohne schon sehr sein seine sich sie sind so soll über um und unter viele vom von vor wann warum was welche welcher weniger wenn wer werden wie will wir wird wo
        würde zu zum zur""".split()),
}


@components.add("tag", "gopher_quality")
class GopherQuality(MapFn):
    """Word, symbol and line metrics; all in Catalyst. Words are what single spaces part, so some are empty."""

    name: str = Field(default="gopher_quality")
    to: str = Field(default="metadata.gopher_quality")
    language: Literal["en", "de"] = Field(default="de")

    def prepare(self, df: DataFrame) -> DataFrame:
        t = F.coalesce(self.text(df), F.lit(""))
        df = with_helpers(df, text=t, words=split_plain(t, " "), parts=F.split(t, LINE_END, -1))
        return with_helpers(df, lines=lines_of(helper("parts")), real=F.filter(helper("words"), lambda w: w.rlike(f"[^{ASCII_PUNCT}]")))

    def column(self, df: DataFrame) -> Column:
        t, ws, lines, real = map(helper, ("text", "words", "lines", "real"))
        n = F.size(ws)
        letters = F.aggregate(real, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
        share = lambda hit: F.size(F.filter(lines, hit)) / F.size(lines).cast("double")
        stops = F.array(*[F.lit(w) for w in sorted(STOP_WORDS[self.language])])
        values = {
            "word_count": (F.size(real).cast("long"), "long"),
            "avg_word_length": (ratio(letters, F.size(real)), "double"),
            "hash_ratio": (ratio(count_plain(t, "#"), n), "double"),
            "ellipsis_ratio": (ratio(count_plain(t, "...") + count_plain(t, "…"), n), "double"),
            "bullet_line_ratio": (share(lambda x: x.rlike(f"^{SPACE}*[•-]")), "double"),
            "ellipsis_line_ratio": (share(lambda x: x.rlike(rf"(?:\.\.\.|…){SPACE}*$")), "double"),
            "stop_word_count": (F.size(F.array_intersect(ws, stops)).cast("long"), "long"),
            "alpha_word_ratio": (ratio(F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))), n), "double"),
        }
        return F.struct(*[F.when(t == "", F.lit(0).cast(k)).otherwise(c).alias(v) for v, (c, k) in values.items()])


PARAGRAPHS, LINES = re.compile("\n{2,}"), re.compile("\n+")
WINDOW = 20  # characters, without spaces, by which starts of long n-grams are told apart


class _Texts:
    """The words between single spaces of some texts, and hashes of their runs.

    Hashes only tell which n-grams can't be repeated in their text; what may be is compared as strings.
    """

    def __init__(self, texts: list[str]) -> None:
        self.words = [t.split(" ") for t in texts]
        c, ends = codes.code_points(texts)
        apart = np.zeros(len(c), bool)
        apart[ends] = True
        self.stop = np.flatnonzero(apart | (c == 32))  # of each word
        self.start = np.r_[0, self.stop[:-1] + 1]
        n = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.end = np.cumsum(n)  # after each text's last word
        self.begin = self.end - n
        self.text = np.repeat(np.arange(len(texts)), n)
        self.power, self.inverse = codes.powers(len(c))
        self.spaced = codes.prefix_hashes(c, self.power)
        plain = np.ones(len(c), bool)
        plain[self.stop] = False
        self.plain = codes.prefix_hashes(c[plain], self.power)
        at = np.arange(len(self.stop))
        self.plain_start, self.plain_stop = self.start - at, self.stop - at
        self._window: np.ndarray | None = None

    def whole(self, n: int) -> np.ndarray:
        """The places where n words of one text begin."""
        at = np.arange(len(self.stop) - n + 1)
        return at[self.text[at] == self.text[at + n - 1]]

    def runs(self, at: np.ndarray, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places that follow each other where the hashes of start to stop are equal within a text, in their order; where each such run begins; its length), only of runs of two or more."""
        h = (sums[stop] - sums[start]) * self.inverse[start] + (self.text[at] + 1).astype(np.uint64) * codes.MIX
        h = (h ^ (h >> np.uint64(31))) * codes.MIX
        low = np.uint64(len(self.stop).bit_length())
        key = np.sort((h >> low << low) | at.astype(np.uint64))  # by hash, then place
        cut = np.flatnonzero(np.diff(key >> low)) + 1
        first = np.r_[0, cut][: len(key)]
        size = np.diff(np.r_[first, len(key)])
        some = size > 1
        at = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)[np.repeat(some, size)]
        size = size[some]
        return at, np.cumsum(size) - size, size

    def maybe_twice(self, n: int) -> np.ndarray:
        """The places, in their order, where n words begin whose letters may stand at another place of the text too."""
        at = self.whole(n)
        start, stop = self.plain_start[at], self.plain_stop[at + n - 1]
        if self._window is None:
            self._window = np.zeros(len(self.stop), bool)
            own = np.flatnonzero(self.plain_start + WINDOW <= self.plain_stop[self.end - 1][self.text])
            self._window[self.runs(own, self.plain, self.plain_start[own], self.plain_start[own] + WINDOW)[0]] = True
        near = (stop - start < WINDOW) | self._window[at]
        return np.sort(self.runs(at[near], self.plain, start[near], stop[near])[0])


def top_chars(ws: list[str], n: int) -> int:
    """Characters of the most frequent n-gram times its count; the first seen wins ties."""
    grams = Counter(map(" ".join, zip(*(ws[i:] for i in range(n)))))
    if not grams:
        return 0
    g, c = grams.most_common(1)[0]
    return len(g) * c


def tops(x: _Texts, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """``top_chars`` of each text for each n."""
    out: dict[int, np.ndarray] = {}
    twice, last = np.ones(len(x.stop), bool), 0
    for n in sorted(set(sizes)):
        at = x.whole(n)
        got = np.zeros(len(x.words), np.int64)
        i = x.begin[x.end - x.begin >= n]  # a text without a repeated n-gram has its first
        got[x.text[i]] = x.stop[i + n - 1] - x.start[i]
        if last:  # both its first and its last words are repeated
            at = at[twice[at] & twice[at + n - last]]
        at, first, size = x.runs(at, x.spaced, x.start[at], x.stop[at + n - 1])
        twice, last = np.zeros(len(x.stop), bool), n
        twice[at] = True
        order = np.lexsort((at[first], -size, x.text[at[first]])) if len(at) else first
        text = x.text[at[first[order]]]
        for k in order[np.r_[True, text[1:] != text[:-1]]].tolist() if len(order) else ():
            places = at[first[k] : first[k] + size[k]]
            t = int(x.text[places[0]])
            ws, b = x.words[t], int(x.begin[t])
            grams = {tuple(ws[i - b : i - b + n]) for i in places.tolist()}
            i = places[0]
            got[t] = (x.stop[i + n - 1] - x.start[i]) * size[k] if len(grams) == 1 else top_chars(ws, n)
        out[n] = got
    return out


def repeated(x: _Texts, n: int) -> np.ndarray:
    """Of each text, a scan from the left: a repeated n-gram counts and is jumped over, a new one is remembered."""
    out = np.zeros(len(x.words), np.int64)
    at = x.maybe_twice(n)
    now, free = -1, 0
    for i, t in zip(at.tolist(), x.text[at].tolist()):
        if t != now:
            now, free, seen, ws, b = t, 0, set(), x.words[t], int(x.begin[t])
        if i < free:
            continue
        g = "".join(ws[i - b : i - b + n])
        if g in seen:
            out[t] += len(g)
            free = i + n
        else:
            seen.add(g)
    return out


def twice(parts: list[str], size: int) -> tuple[float, float]:
    """The shares of parts, and of the text's characters in them, that stand before already."""
    once = set(parts)
    if len(once) == len(parts):
        return 0.0, 0.0
    return (len(parts) - len(once)) / len(parts), (sum(map(len, parts)) - sum(map(len, once))) / size


@components.add("tag", "gopher_repetition")
class GopherRepetition(MapFn):
    """Line, paragraph and n-gram repetition of many texts at once."""

    name: str = Field(default="gopher_repetition")
    to: str = Field(default="metadata.gopher_repetition")
    top_n_grams: tuple[int, ...] = Field(default=(2, 3, 4))
    dup_n_grams: tuple[int, ...] = Field(default=(5, 6, 7, 8, 9, 10))

    def column(self, df: DataFrame) -> Column:
        top, dup = self.top_n_grams, self.dup_n_grams
        names = ["dup_para_frac", "dup_para_char_frac", "dup_line_frac", "dup_line_char_frac", *[f"top_{n}_gram_char_frac" for n in top], *[f"dup_{n}_gram_char_frac" for n in dup]]

        def measure(texts: list[str | None]) -> pa.Array:
            ts = [t or "" for t in texts]
            size = np.maximum(np.fromiter(map(len, ts), np.int64, len(ts)), 1)
            parts = [(*twice(PARAGRAPHS.split(t.strip()), k), *twice(LINES.split(t), k)) for t, k in zip(ts, size.tolist())]
            x = _Texts(ts)
            most = tops(x, top)
            cols = [*zip(*parts), *[most[n] / size for n in top], *[repeated(x, n) / size for n in dup]]
            return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in cols], names=names)

        return text_udf(", ".join(f"{n} double" for n in names), lambda: measure)(self.text(df))


def _more(stat, field: str, most: float, default: float = 0.0) -> Column:
    """stat > most, with NaN never more, as in Python."""
    c = F.coalesce(stat(field), F.lit(default))
    return (c > most) & ~F.isnan(c)


class _Stats(FilterFn):
    def stat(self, df: DataFrame):
        def get(name: str) -> Column:
            path = f"{self.on}.{name}"
            return get_field(df, path).cast("double") if field_type(df.schema, path) is not None else F.lit(None).cast("double")

        return get


@components.add("filter", "gopher_quality")
class GopherQualityFilter(_Stats):
    """As the reference has it (compat), texts of nearly only alphabetic words are rejected; corrected: of too few."""

    name: str = Field(default="gopher_quality")
    on: str = Field(default="metadata.gopher_quality")
    min_avg_word_length: float = Field(default=4.8, gt=0)
    max_avg_word_length: float = Field(default=7.3, gt=0)
    max_symbol_word_ratio: float = Field(default=0.1, ge=0, le=1)
    max_bullet_line_ratio: float = Field(default=0.7, ge=0, le=1)
    max_ellipsis_line_ratio: float = Field(default=0.3, ge=0, le=1)
    max_non_alpha_words_ratio: float = Field(default=0.99, ge=0, le=1)
    min_stop_words: int = Field(default=6, ge=0)
    semantics: Semantics = Field(default="compat")

    def predicate(self, df: DataFrame) -> Column:
        s = self.stat(df)
        alpha = s("alpha_word_ratio")
        bad = (
            (F.coalesce(s("stop_word_count"), F.lit(100_000.0)) < self.min_stop_words)
            | (_more(s, "alpha_word_ratio", self.max_non_alpha_words_ratio) if self.semantics == "compat" else F.coalesce(1 - alpha > self.max_non_alpha_words_ratio, F.lit(False)))
            | _more(s, "ellipsis_line_ratio", self.max_ellipsis_line_ratio)
            | _more(s, "bullet_line_ratio", self.max_bullet_line_ratio)
            | _more(s, "avg_word_length", self.max_avg_word_length)
            | (F.coalesce(s("avg_word_length"), F.lit(100.0)) < self.min_avg_word_length)
            | _more(s, "ellipsis_ratio", self.max_symbol_word_ratio)
            | _more(s, "hash_ratio", self.max_symbol_word_ratio)
        )
        return ~bad


Limits = tuple[tuple[int, float], ...]


@components.add("filter", "gopher_repetition")
class GopherRepetitionFilter(_Stats):
    """After the four hard limits, compat asks that all top n-grams exceed theirs or no repeated one does; corrected, that none exceeds."""

    name: str = Field(default="gopher_repetition")
    on: str = Field(default="metadata.gopher_repetition")
    max_dup_line_frac: float | None = Field(default=0.25, ge=0, le=1)
    max_dup_para_frac: float | None = Field(default=0.3, ge=0, le=1)
    max_dup_line_char_frac: float | None = Field(default=0.15, ge=0, le=1)
    max_dup_para_char_frac: float | None = Field(default=0.2, ge=0, le=1)
    top_n_gram_thresholds: Limits = Field(default=tuple(zip((2, 3, 4), (0.07, 0.10, 0.13))))
    dup_n_gram_thresholds: Limits = Field(default=tuple(zip(range(5, 11), (0.39, 0.39, 0.38, 0.38, 0.37, 0.37))))
    semantics: Semantics = Field(default="compat")

    def predicate(self, df: DataFrame) -> Column:
        s, ok = self.stat(df), F.lit(True)
        for name in ("dup_line_frac", "dup_para_frac", "dup_line_char_frac", "dup_para_char_frac"):
            if getattr(self, f"max_{name}") is not None:
                ok = ok & ~_more(s, name, getattr(self, f"max_{name}"))
        top = [_more(s, f"top_{n}_gram_char_frac", t) for n, t in self.top_n_gram_thresholds]
        none_dup = F.lit(True)
        for n, t in self.dup_n_gram_thresholds:
            none_dup = none_dup & ~_more(s, f"dup_{n}_gram_char_frac", t)
        all_top = none_top = F.lit(True)
        for c in top:
            all_top, none_top = all_top & c, none_top & ~c
        return ok & ((all_top | none_dup) if self.semantics == "compat" else (none_top & none_dup))
