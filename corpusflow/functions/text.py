"""Text expressions with Python's meaning of white space, words and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\p{Z}\t\n\x0b\f\r\x1c-\x1f\x85]"
NOT_SPACE = r"[^\p{Z}\t\n\x0b\f\r\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]"
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ASCII_PUNCT = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def split_words(c: Column) -> Column:
    """The runs that str.split() without arguments gives."""
    return F.regexp_extract_all(c, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def split_plain(c: Column, delimiter: str) -> Column:
    """str.split(delimiter): empty pieces stay."""
    quoted = "".join(f"\\{ch}" if not ch.isalnum() and ch.isascii() and ch != "\n" else ch for ch in delimiter)
    return F.split(c, quoted, -1)


def split_lines(c: Column) -> Column:
    """str.splitlines(): a last line end opens no line."""
    return lines_of(F.split(c, LINE_END, -1))


def lines_of(parts: Column) -> Column:
    """The lines among what lies between line ends."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def count_plain(c: Column, needle: str) -> Column:
    """str.count(needle)."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1) as a double."""
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")
