"""Dotted field paths over a static schema, and the truthiness test of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _name(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path, or None where the path leads nowhere."""
    kind: T.DataType = schema
    for part in path.split(".") if path else [""]:
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


def get_field(df: DataFrame, path: str) -> Column:
    """The column at a path; a typeless null where it is missing."""
    if field_type(df.schema, path) is None:
        return F.lit(None)
    first, *rest = path.split(".")
    col = F.col(_name(first))
    for part in rest:
        col = col.getField(part)
    return col


def _put(kind: T.DataType | None, base: Column | None, rest: list[str], value: Column, path: str) -> Column:
    if not rest:
        return value
    if kind is not None and not isinstance(kind, T.StructType):
        raise TypeError(f"cannot set {path!r}: {rest[0]!r} would lie in a {kind.simpleString()}")
    fields = [(f.name, f.dataType, base.getField(f.name)) for f in kind.fields] if kind is not None else []
    own = next(((k, c) for n, k, c in fields if n == rest[0]), (None, None))
    new = _put(own[0], own[1], rest[1:], value, path).alias(rest[0])
    cols = [new if n == rest[0] else c.alias(n) for n, _, c in fields]
    return F.struct(*cols, *([] if own[0] is not None else [new]))


def set_field(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Set a nested field, with structs made where they are missing.

    A null parent becomes a struct of nulls. A parent that is no struct is a
    TypeError, an empty path a ValueError.
    """
    if not path:
        raise ValueError("the field path is empty")
    first, *rest = path.split(".")
    kind = df.schema[first].dataType if first in df.columns else None
    return df.withColumn(first, _put(kind, F.col(_name(first)) if kind is not None else None, rest, value, path))


ONCE = "_once_"  # begins the names of helper columns


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Further columns, each computed once a row however often it is read.

    A generator of one element makes them. The optimizer neither copies expressions across it nor
    pushes tests of its columns below it, while tests of other columns still reach the scan.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def helper(name: str) -> Column:
    return F.col(ONCE + name)


def with_helpers(df: DataFrame, **cols: Column) -> DataFrame:
    """``once`` under names that no field has."""
    return once(df, **{ONCE + n: c for n, c in cols.items()})


def without_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(ONCE)])


def settle(df: DataFrame, path: str) -> DataFrame:
    """The same frame; what lies at the first part of the path is computed once, here."""
    first = path.split(".")[0]
    return without_helpers(with_helpers(df, settled=F.col(_name(first))).withColumn(first, helper("settled")))


def is_missing(df: DataFrame, path: str) -> Column:
    """What a falsy Python value is: null, '', 0, false and empty containers (NaN is there)."""
    kind, col = field_type(df.schema, path), get_field(df, path)
    if kind is None or isinstance(kind, T.NullType):
        return F.lit(True)
    if isinstance(kind, T.StringType):
        return F.coalesce(col == "", F.lit(True))
    if isinstance(kind, T.NumericType):
        return F.coalesce(col == 0, F.lit(True))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(~col, F.lit(True))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(col) < 1, F.lit(True))
    return col.isNull()
