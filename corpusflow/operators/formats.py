"""Repairs of spacing and of broken Unicode."""

from __future__ import annotations

import html
import re
import unicodedata
from typing import Literal

import pyarrow as pa
from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrow import text_udf
from corpusflow.functions.text import SPACE, WORD
from corpusflow.plans.base import MapFn
from corpusflow.plans.registry import components


@components.add("format", "spacing")
class Spacing(MapFn):
    """Runs of blanks, paragraph breaks, hyphenation and line breaks, in this order; all in Catalyst."""

    name: str = Field(default="spacing")
    fix_umlaut_notation: bool = Field(default=True, description="Accepted, without effect")
    fix_hyphenation: bool = Field(default=True)
    normalize_whitespace: bool = Field(default=True)
    normalize_line_breaks: bool = Field(default=True)
    collapse_paragraph_breaks: bool = Field(default=True)

    def column(self, df: DataFrame) -> Column:
        t = self.text(df)
        steps = (
            (self.normalize_whitespace, "[ \t]+", " "),
            (self.normalize_line_breaks, "\n{3,}", "\n\n"),
            (self.fix_hyphenation, f"({WORD})-{SPACE}*\n{SPACE}*({WORD})", "$1$2"),
            (self.collapse_paragraph_breaks, "(?<!\n)\n(?!\n)", " "),
            (True, " {2,}", " "),
        )
        for on, pattern, to in steps:
            if on:
                t = F.regexp_replace(t, pattern, to)
        return t


LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "ŉ": "'n", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
CONTROLS = r"[\x00-\x08\x0b\x0e-\x1f\x7f⁪-⁯﻿￹-￼]"
_TAIL = "\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™"
MOJIBAKE = re.compile(f"[Â-ß][{_TAIL}]|[à-ï][{_TAIL}]{{2}}")


def undo_mojibake(t: str) -> str:
    """UTF-8 that was read as cp1252 or Latin-1, up to three times over."""
    for _ in range(3):
        if not MOJIBAKE.search(t):
            return t
        raw = bytearray()
        try:
            for c in t:
                try:
                    raw += c.encode("cp1252")
                except UnicodeEncodeError:
                    raw += c.encode("latin-1")
            new = raw.decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return t
        if new == t:
            return t
        t = new
    return t


def repair(t: str, encoding: bool, entities: bool, form: str | None) -> str:
    if entities and "<" not in t and "&" in t:
        t = html.unescape(t)
    if encoding:
        t = undo_mojibake(t)
    return unicodedata.normalize(form, t) if form else t


@components.add("format", "ftfy")
class UnicodeRepair(MapFn):
    """Steps by flag. Entities, mojibake and normal forms need a worker; the others are Catalyst's."""

    name: str = Field(default="unicode_repair")
    fix_encoding: bool = Field(default=True)
    fix_entities: bool = Field(default=True)
    remove_terminal_escapes: bool = Field(default=True)
    fix_latin_ligatures: bool = Field(default=True)
    fix_character_width: bool = Field(default=True)
    uncurl_quotes: bool = Field(default=True)
    fix_line_breaks: bool = Field(default=True)
    fix_surrogates: bool = Field(default=True, description="Accepted; Spark's strings hold no surrogates")
    remove_control_chars: bool = Field(default=True)
    normalization: Literal["NFC", "NFD", "NFKC", "NFKD"] | None = Field(default="NFC")

    def column(self, df: DataFrame) -> Column:
        t = self.text(df)
        encoding, entities, form = self.fix_encoding, self.fix_entities, self.normalization

        def fixed(texts: list[str | None]) -> pa.Array:
            return pa.array([repair(x, encoding, entities, form) if x else x for x in texts], pa.string())

        if encoding or entities or form:
            t = text_udf("string", lambda: fixed)(t)
        if self.remove_terminal_escapes:
            t = F.regexp_replace(t, "\x1b\\[[0-9;]*[a-zA-Z]", "")
        if self.fix_latin_ligatures:
            for a, b in LIGATURES.items():
                t = F.replace(t, F.lit(a), F.lit(b))
        if self.fix_character_width:
            t = F.translate(t, WIDE, NARROW)
        if self.uncurl_quotes:
            t = F.translate(t, "‘’‚‛ʼ“”„‟", "'''''\"\"\"\"")
        if self.fix_line_breaks:
            t = F.regexp_replace(t, "\r\n?|[  \u0085]", "\n")
        if self.remove_control_chars:
            t = F.regexp_replace(t, CONTROLS, "")
        return t
