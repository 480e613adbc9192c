"""Length and token counts, n-grams."""

from __future__ import annotations

import os
import re
import string
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrow import text_udf
from corpusflow.functions.text import count_plain, split_plain, strip
from corpusflow.plans.base import MapFn
from corpusflow.plans.registry import components

PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@components.add("tag", "length")
class Length(MapFn):
    name: str = Field(default="length")
    to: str = Field(default="metadata.length")
    count_characters: bool = Field(default=True)
    count_words: bool = Field(default=True)
    count_lines: bool = Field(default=True)
    count_paragraphs: bool = Field(default=False)
    word_delimiter: str = Field(default=" ")

    def column(self, df: DataFrame) -> Column:
        t = F.coalesce(self.text(df), F.lit(""))

        def pieces(delimiter: str) -> Column:
            return F.size(F.filter(split_plain(t, delimiter), lambda x: strip(x) != "")).cast("long")

        lines = F.when(t == "", F.lit(0)).otherwise(count_plain(t, "\n") + 1).cast("long")
        wanted = (
            (self.count_characters, "char_count", lambda: F.length(t).cast("long")), (self.count_words, "word_count", lambda: pieces(self.word_delimiter)),
            (self.count_lines, "line_count", lambda: lines), (self.count_paragraphs, "paragraph_count", lambda: pieces("\n\n")),
        )
        return F.struct(*[make().alias(n) for on, n, make in wanted if on])


@components.add("tag", "token_count")
class TokenCount(MapFn):
    """Tokens by a tokenizer file; without one, GPT-2's pre-tokens are counted in Catalyst (fewer than tokens)."""

    name: str = Field(default="token_count")
    to: str = Field(default="metadata.token_count")
    pretrained_tokenizer_name_or_path: str | None = Field(default=None, description="Path of a tokenizer.json that every worker can read")
    add_special_tokens: bool = Field(default=False)
    use_fast: bool = Field(default=True, description="Accepted; there are only fast ones")

    def column(self, df: DataFrame) -> Column:
        path, special = self.pretrained_tokenizer_name_or_path, self.add_special_tokens
        if not path:
            return F.regexp_count(self.text(df), F.lit(PRETOKEN)).cast("long")
        if not os.path.exists(path):
            raise ValueError(f"no tokenizer file {path!r}")

        def load() -> Callable[[list[str | None]], pa.Array]:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True

            def count(texts: list[str | None]) -> pa.Array:
                n = iter([len(e.ids) for e in t.encode_batch_fast([x for x in texts if x is not None], add_special_tokens=special)])
                return pa.array([None if x is None else next(n) for x in texts], pa.int64())

            return count

        return text_udf("long", load)(self.text(df))


NGRAMS = "array<struct<ngram:string,count:bigint>>"
_BREAK = re.compile(f"[{re.escape(string.punctuation + string.whitespace)}]+")


def ngram_counts(text: str | None, n: int, k: int | None) -> list[tuple[str, int]]:
    if not text or not text.strip():
        return []
    ws = _BREAK.split(text)
    return Counter(map(" ".join, zip(*(ws[i:] for i in range(n))))).most_common(k)


@components.add("tag", "ngrams")
class NGrams(MapFn):
    """Counts of the word n-grams of a text, most frequent first, the first seen first among equals."""

    name: str = Field(default="ngrams")
    to: str = Field(default="metadata.ngrams")
    ngram_size: int = Field(default=5, gt=0)
    top_k: int | None = Field(default=None, gt=0)

    def column(self, df: DataFrame) -> Column:
        n, k = self.ngram_size, self.top_k

        def count(texts: list[str | None]) -> pa.Array:
            found = [ngram_counts(t, n, k) for t in texts]
            ends = np.cumsum([0, *map(len, found)])
            grams = pa.StructArray.from_arrays([pa.array([g for f in found for g, _ in f], pa.string()), pa.array([c for f in found for _, c in f], pa.int64())], names=["ngram", "count"])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), grams)

        return text_udf(NGRAMS, lambda: count)(self.text(df))
