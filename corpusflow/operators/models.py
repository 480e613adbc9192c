"""Taggers that need a model: language and perplexity, with backends that are built in or trained here."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Literal

import numpy as np
import pandas as pd
import pyarrow as pa
from pydantic import Field, PrivateAttr
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.arrow import pieces, strings, text_udf
from corpusflow.functions.fields import helper, with_helpers
from corpusflow.functions.text import WORD, strip
from corpusflow.plans.base import MapFn
from corpusflow.plans.registry import components

PROFILES = {
    "de": "aber als auch auf bei das dem den der des die durch ein eine einen einer er es für hat ich im ist mit nach nicht oder sich sie sind um und von war wie wird zu zum zur",
    "en": "a an and are as at be but by for from had has have he her his in is it not of on or that the their they this to was were which with you",
    "es": "al como con de del el en es está han la las lo los más no o para pero por que se sin sobre su sus también un una y ya",
    "fr": "au aux avec ce cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous",
}


def _hits(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known))).cast("double")


@components.add("tag", "language")
class LanguageTagger(MapFn):
    """Names and scores of the likeliest languages. The built-in backend counts function words of four
    languages in Catalyst and is approximate; a fastText model file replaces it."""

    name: str = Field(default="language")
    to: str = Field(default="metadata.language")
    fasttext_model_path: str | None = Field(default=None, description="Model file that every worker can read; needs the fasttext package")
    k: int = Field(default=1, ge=1, le=10)
    max_tokens: int = Field(default=4096, gt=0, description="Characters that are looked at")
    confidence_threshold: float = Field(default=0.0, ge=0, le=1)

    def prepare(self, df: DataFrame) -> DataFrame:
        t = F.substring(strip(F.replace(F.coalesce(self.text(df), F.lit("")), F.lit("\n"), F.lit(" "))), 1, self.max_tokens)
        if self.fasttext_model_path is None:
            df = with_helpers(df, words=F.regexp_extract_all(F.lower(t), F.lit(f"{WORD}+"), F.lit(0)))
            df = with_helpers(df, **{lang: _hits(helper("words"), ws.split()) for lang, ws in PROFILES.items()})
        return with_helpers(df, found=self.found(t))

    def found(self, t: Column) -> Column:
        """The likeliest languages, as structs of a score and a name."""
        if self.fasttext_model_path:
            path, k = self.fasttext_model_path, self.k

            @F.pandas_udf("array<struct<s:double,n:string>>")
            def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                import fasttext

                model = fasttext.load_model(path)
                for s in batches:
                    yield s.map(lambda x: [{"s": float(p), "n": n.replace("__label__", "")} for n, p in zip(*model.predict(x, k=k))] if x else [])

            return F.filter(predict(t), lambda x: x["s"] >= self.confidence_threshold)
        total = sum((helper(lang) for lang in PROFILES), F.lit(0.0))
        each = F.array(*[F.struct((helper(lang) / F.greatest(total, F.lit(1.0))).alias("s"), F.lit(lang).alias("n")) for lang in PROFILES])
        best = F.array_sort(each, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["n"] < b["n"], -1).otherwise(1))
        return F.filter(F.slice(best, 1, self.k), lambda x: (x["s"] > 0) & (x["s"] >= self.confidence_threshold))

    def column(self, df: DataFrame) -> Column:
        found = helper("found")
        unknown = F.struct(F.array(F.lit("unknown")).alias("names"), F.array(F.lit(0.0)).alias("scores"))
        named = F.struct(F.transform(found, lambda x: x["n"]).alias("names"), F.transform(found, lambda x: x["s"]).alias("scores"))
        return F.when(F.size(found) > 0, named).otherwise(unknown)


PUNCTUATION = dict(zip("，。、„”“«»１」「《》´∶：？！（）；–．～’…━〈〉【】％►—", (",", ".", ",", *'""""""""""', "'", ":", ":", "?", "!", "(", ")", ";", "-", ". ", "~", "'", "...", "-", "<", ">", "[", "]", "%", "-", " - ")))


def normalise(t: Column, case: bool = False, accents: bool = False, numbers: bool = True, punctuation: int = 1) -> Column:
    """Lower case, accents, digits to 0, Unicode punctuation (1: to ASCII, 2: away), no control characters."""
    t = strip(t)
    t = F.lower(t) if case else t
    t = F.translate(t, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy") if accents else t
    t = F.regexp_replace(t, r"\p{Nd}", "0") if numbers else t
    for a, b in PUNCTUATION.items() if punctuation else ():
        t = F.replace(t, F.lit(a), F.lit(b if punctuation == 1 else ""))
    return F.regexp_replace(t, r"[\x00-\x1f\x7f-\x9f]", "")


class ByteBigrams:
    """An add-k model of each byte after the one before: 65,536 numbers, however large the corpus."""

    def __init__(self, counts: np.ndarray, k: float = 0.5):
        c = counts.reshape(256, 256) + k
        self.log10 = np.log10(c / c.sum(axis=1, keepdims=True)).ravel()

    @classmethod
    def train(cls, df: DataFrame, on: str = "text") -> ByteBigrams:
        def count(batches):
            total = np.zeros(65536, np.int64)
            for b in batches:
                for t in (t for p in pieces(b.column(0)) for t in strings(p)):
                    x = np.frombuffer(f"\n{t or ''}\n".encode(), np.uint8).astype(np.int64)
                    total += np.bincount(x[:-1] * 256 + x[1:], minlength=65536)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

        counts = np.zeros(65536)
        for r in df.select(normalise(F.col(on)).alias("t")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
            counts[r[0]] = r[1]
        return cls(counts)

    def perplexity(self, t: str | None) -> float:
        if not t:
            return -1.0
        x = np.frombuffer(f"\n{t}\n".encode(), np.uint8).astype(np.int64)
        score = float(self.log10[x[:-1] * 256 + x[1:]].sum())
        return round(math.pow(10, -score / (len(x) - 1)), 1)


@components.add("tag", "perplexity")
class Perplexity(MapFn):
    """Perplexity of the normalised text. The model is a byte bigram trained by a Spark job over the frame
    itself, over whole texts, or one given to ``use``; it is approximate beside a word model. ``max_chars`` limits
    what is scored, as in the reference, and not what is trained on. -1 where there is no text."""

    name: str = Field(default="perplexity")
    to: str = Field(default="perplexity")
    language: Literal["de", "en"] = Field(default="de")
    max_chars: int = Field(default=2**16, gt=0)
    _model: ByteBigrams | None = PrivateAttr(default=None)

    def use(self, model: ByteBigrams) -> Perplexity:
        self._model = model
        return self

    def learns(self) -> bool:
        return self._model is None

    def column(self, df: DataFrame) -> Column:
        whole = F.coalesce(self.text(df), F.lit(""))
        model = self._model or ByteBigrams.train(df.select(whole.alias("text")))
        text = F.substring(whole, 1, self.max_chars)

        def score(texts: list[str | None]) -> pa.Array:
            return pa.array([model.perplexity(t) for t in texts], pa.float64())

        return text_udf("double", lambda: score)(normalise(text))
