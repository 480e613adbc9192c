"""Ingest, plain copies, constant values, and the simple filters."""

from __future__ import annotations

from typing import Any, Literal

from pydantic import Field, model_validator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.fields import field_type, get_field, is_missing, set_field
from corpusflow.plans.base import FilterFn, MapFn, Semantics
from corpusflow.plans.registry import components


@components.add("ingest", "base")
class BaseIngest(MapFn):
    """The common shape: id, text, source, metadata.subset and .license where asked, and the columns in ``other``."""

    name: str = Field(default="ingest")
    on: str | None = Field(default=None)
    to: str = Field(default="text")
    id_column: str = Field(description="Column of the id; missing ids become a hash of the text")
    text_column: str = Field(description="Column of the text; missing texts become empty")
    source_name_or_column: str = Field(description="Column of the source, or the source itself")
    subset_name_or_column: str | None = Field(default=None, description="Column or literal")
    license_name_or_column: str | None = Field(default=None, description="Column or literal")
    other: list[str] | None = Field(default=None, description="Further columns to keep")

    def transform(self, df: DataFrame) -> DataFrame:
        def value(name: str) -> Column:
            return F.when(is_missing(df, name), F.lit(name)).otherwise(get_field(df, name).cast("string"))

        text = F.when(is_missing(df, self.text_column), F.lit("")).otherwise(get_field(df, self.text_column).cast("string"))
        ident = F.coalesce(F.nullif(get_field(df, self.id_column).cast("string"), F.lit("")), F.sha2(text, 256))
        out = df.select(ident.alias("id"), text.alias("text"), value(self.source_name_or_column).alias("source"), *[get_field(df, c).alias(c) for c in self.other or []],
                        *[value(n).alias(f"_{k}") for k, n in (("subset", self.subset_name_or_column), ("license", self.license_name_or_column)) if n])
        for k in ("subset", "license"):
            if f"_{k}" in out.columns:
                out = set_field(out, f"metadata.{k}", F.col(f"_{k}")).drop(f"_{k}")
        return out

    __call__ = transform


@components.add("extract", "plain")
class PlainExtractor(MapFn):
    name: str = Field(default="plain")

    def column(self, df: DataFrame) -> Column:
        return get_field(df, self.on)


@components.add("tag", "value")
class ValueTagger(MapFn):
    """A constant, or another field's value, optionally only where nothing is yet."""

    name: str = Field(default="value")
    on: str | None = Field(default=None, description="Field to copy")
    to: str = Field(description="Field that is written")
    value: Any = Field(default=None, description="Constant to write")
    replace_if_present: bool = Field(default=True, description="Overwrite a value that is there")

    @model_validator(mode="after")
    def _one(self) -> ValueTagger:
        if self.on is not None and self.value is not None:
            raise ValueError("give a constant or a field, not both")
        return self

    def column(self, df: DataFrame) -> Column:
        new = get_field(df, self.on) if self.on is not None else F.lit(self.value)
        if self.replace_if_present or field_type(df.schema, self.to) is None:
            return new
        return F.coalesce(get_field(df, self.to), new)


Comparator = Literal["eq", "neq", "gt", "lt", "gte", "lte", "inl", "inr", "ninl", "ninr"]


@components.add("filter", "value")
class ValueFilter(FilterFn):
    """Compares a field with a value. As the reference has it (compat), ``if_missing`` true keeps every row."""

    name: str = Field(default="value")
    value: Any = Field(description="What to compare with")
    comparator: Comparator = Field(default="eq")
    semantics: Semantics = Field(default="compat")

    def predicate(self, df: DataFrame) -> Column:
        got, kind, v = get_field(df, self.on), field_type(df.schema, self.on), self.value
        if self.comparator in ("inr", "ninr"):
            hit = got.isin(*v) if not isinstance(v, str) else F.contains(F.lit(v), got)
        elif self.comparator in ("inl", "ninl"):
            hit = F.array_contains(got, v) if isinstance(kind, T.ArrayType) else F.map_contains_key(got, v) if isinstance(kind, T.MapType) else F.contains(got, F.lit(v))
        else:
            hit = {"eq": got.eqNullSafe(v), "neq": ~got.eqNullSafe(v), "gt": got > v, "lt": got < v, "gte": got >= v, "lte": got <= v}[self.comparator]
        if self.comparator[0] == "n" and self.comparator != "neq":
            hit = ~hit
        return hit | F.lit(self.if_missing) if self.semantics == "compat" else hit


@components.add("filter", "exists")
class ExistsFilter(FilterFn):
    """Empty strings and zeros are there; only nulls aren't."""

    name: str = Field(default="exists")

    def keep(self, df: DataFrame) -> Column:
        return get_field(df, self.on).isNotNull()


@components.add("filter", "expr")
class ExprFilter(FilterFn):
    """A SQL predicate of the user's."""

    name: str = Field(default="expr")
    expr: str = Field(description="SQL expression")

    def reads(self) -> None:
        return None

    def keep(self, df: DataFrame) -> Column:
        return F.coalesce(F.expr(self.expr), F.lit(self.if_missing))


@components.add("filter", "language")
class LanguageFilter(FilterFn):
    """A plain string of allowed languages is searched for each name, so 'e' is allowed by 'en'."""

    name: str = Field(default="language")
    on: str = Field(default="metadata.language")
    if_missing: bool = Field(default=False)
    allowed_languages: str | list[str] = Field(default="en")
    min_confidence: float = Field(default=0.5, ge=0, le=1)
    allow_partial_match: bool = Field(default=True, description="One match is enough; else all must match")

    def keep(self, df: DataFrame) -> Column:
        names, scores = get_field(df, f"{self.on}.names"), get_field(df, f"{self.on}.scores")
        if field_type(df.schema, f"{self.on}.names") is None or field_type(df.schema, f"{self.on}.scores") is None:
            return F.lit(self.if_missing)
        gone = is_missing(df, f"{self.on}.names") | is_missing(df, f"{self.on}.scores")
        if isinstance(field_type(df.schema, f"{self.on}.names"), T.StringType):
            names = F.array(names)
        if isinstance(field_type(df.schema, f"{self.on}.scores"), T.NumericType):
            scores = F.array(scores)
        n = F.least(F.size(names), F.size(scores))
        both = F.arrays_zip(F.slice(names, F.lit(1), n).alias("n"), F.slice(scores, F.lit(1), n).alias("s"))
        allowed = self.allowed_languages

        def match(x: Column) -> Column:
            known = F.contains(F.lit(allowed), x["n"]) if isinstance(allowed, str) else x["n"].isin(*allowed)
            return F.coalesce(known & (x["s"] >= self.min_confidence), F.lit(False))

        return F.when(gone, F.lit(self.if_missing)).otherwise(F.exists(both, match) if self.allow_partial_match else F.forall(both, match))


@components.add("filter", "token_count")
class TokenCountFilter(FilterFn):
    """Zero tokens count as missing."""

    name: str = Field(default="token_count")
    on: str = Field(default="metadata.token_count")
    if_missing: bool = Field(default=False)
    min_tokens: int = Field(default=10)
    max_tokens: int | None = Field(default=None)

    def predicate(self, df: DataFrame) -> Column:
        n = get_field(df, self.on)
        return (n >= self.min_tokens) & (F.lit(True) if self.max_tokens is None else n <= self.max_tokens)
