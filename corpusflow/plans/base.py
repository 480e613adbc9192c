"""Base classes of components: maps, filters and aggregations over DataFrames."""

from __future__ import annotations

from typing import Literal

from pydantic import BaseModel, ConfigDict, Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fields import get_field, is_missing, set_field, settle, without_helpers
from corpusflow.storage import materialize

Semantics = Literal["compat", "corrected"]


class Component(BaseModel):
    model_config = ConfigDict(extra="forbid")


class MapFn(Component):
    """One value a row: a component gives a column, or transforms the frame."""

    name: str = Field(default="map", description="Name of the step")
    on: str | None = Field(default="text", description="Field that is read")
    to: str = Field(default="text", description="Field that is written")

    def prepare(self, df: DataFrame) -> DataFrame:
        """The frame with the helper columns that ``column`` reads more than once."""
        return df

    def column(self, df: DataFrame) -> Column:
        """The value, over a prepared frame."""
        raise NotImplementedError

    def learns(self) -> bool:
        """Whether ``column`` runs a job over the frame."""
        return False

    def text(self, df: DataFrame) -> Column:
        return get_field(df, self.on).cast("string")

    def transform(self, df: DataFrame) -> DataFrame:
        ready = self.prepare(df)
        return without_helpers(set_field(ready, self.to, self.column(ready)))

    __call__ = transform


class FilterFn(Component):
    """Keeps the rows for which the predicate holds."""

    name: str = Field(default="filter", description="Name of the step")
    on: str = Field(default="text", description="Field that is tested")
    if_missing: bool = Field(default=True, description="Result where the field is missing")

    def reads(self) -> str | None:
        """The one field that is tested, or None where it may be any."""
        return self.on

    def predicate(self, df: DataFrame) -> Column:
        """The test where the field is there."""
        raise NotImplementedError

    def keep(self, df: DataFrame) -> Column:
        """A plain disjunction or conjunction, whose parts can reach the scan; a null drops the row."""
        gone = is_missing(df, self.on)
        return gone | self.predicate(df) if self.if_missing else ~gone & self.predicate(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.filter(self.keep(df))

    __call__ = transform


def _reads(step: MapFn | FilterFn, path: str) -> bool:
    return step.on is None or step.on.split(".")[0] == path.split(".")[0]


def _apart(a: str, b: str) -> bool:
    """Whether neither path leads through the other."""
    return not f"{a}.".startswith(f"{b}.") and not f"{b}.".startswith(f"{a}.")


def filters_first(steps: list[MapFn | FilterFn]) -> list[MapFn | FilterFn]:
    """The same steps, each filter as early as what it tests is there, so that later steps see fewer rows.

    A filter passes only maps of single rows that write elsewhere: none that sees other rows, learns
    from them or has a transform of its own.
    """
    out: list[MapFn | FilterFn] = []
    for s in steps:
        at = len(out)
        if isinstance(s, FilterFn) and s.reads() is not None:
            while at and isinstance(m := out[at - 1], MapFn) and type(m).transform is MapFn.transform and not m.learns() and _apart(m.to, s.reads()):
                at -= 1
        out.insert(at, s)
    return out


def apply_steps(df: DataFrame, steps: list[MapFn | FilterFn]) -> DataFrame:
    """The steps one after another, filters as early as they can be.

    What a step makes and a later one reads is computed once, and tests of it stay above it; tests of
    source columns are still pushed down to the scan. The plan grows with the number of steps alone.
    A frame that a step learns from is written to the shared folder, so that what comes before runs once.
    """
    steps = filters_first(steps)
    for i, s in enumerate(steps):
        if i and isinstance(s, MapFn) and s.learns() and "void" not in df.schema.simpleString():
            df = materialize(df, "steps")
        df = s.transform(df)
        if isinstance(s, MapFn) and any(_reads(t, s.to) for t in steps[i + 1 :]):
            df = settle(df, s.to)
    return df


class ReduceFn(Component):
    """An aggregate column, or for tables of their own a transform."""

    name: str = Field(description="Name of the result")
    on: str | None = Field(default=None, description="Field that is aggregated")
    ignore_nulls: bool = Field(default=False, description="Skip nulls; else one null makes the result null")

    def aggregate(self, col: Column) -> Column:
        raise NotImplementedError

    def column(self, df: DataFrame) -> Column:
        col = get_field(df, self.on) if self.on else F.lit(1)
        out = self.aggregate(col)
        if not self.ignore_nulls:
            out = F.when(F.count_if(col.isNull()) > 0, F.lit(None)).otherwise(out)
        return out.alias(self.name)


