"""Aggregations: nine scalar ones and the n-gram counter, global or grouped."""

from __future__ import annotations

import re

from pydantic import Field
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.fields import _name, field_type, get_field
from corpusflow.plans.base import ReduceFn
from corpusflow.plans.registry import components
from corpusflow.storage import materialize


def _simple(name: str, fn, doc: str):
    def aggregate(self, col: Column) -> Column:
        return fn(col)

    cls = type(name.title(), (ReduceFn,), {"aggregate": aggregate, "__doc__": doc, "__module__": __name__})
    return components.add("aggregation", name)(cls)


Sum = _simple("sum", F.sum, "The sum.")
Mean = _simple("mean", F.avg, "The mean.")
Min = _simple("min", F.min, "The least value.")
Max = _simple("max", F.max, "The largest value.")
Std = _simple("std", F.stddev_samp, "The sample standard deviation; null for one value.")
AbsMax = _simple("absmax", lambda c: F.max(F.abs(c)), "The largest absolute value.")


@components.add("aggregation", "count")
class Count(ReduceFn):
    """Rows, or with ``ignore_nulls`` those with a value."""

    def column(self, df: DataFrame) -> Column:
        return F.count(get_field(df, self.on) if self.ignore_nulls and self.on else F.lit(1)).alias(self.name)


BUCKETS = 1 << 16
_PLAIN = ("Relation", "LogicalRDD", "LocalRelation", "Range", "Project", "Filter", "Repartition", "RepartitionByExpression")


def _rescanned(df: DataFrame) -> DataFrame:
    """The frame itself if it is a scan with plain expressions; any other is written first, so that it is made once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = re.findall(r"^[ :+-]*([A-Za-z]+)", plan, re.M)
    return df if all(n in _PLAIN for n in nodes) and not re.search(r"UDF|\brandn?\(|\buuid\(", plan) else materialize(df, "quantile")


@components.add("aggregation", "quantile")
class Quantile(ReduceFn):
    """Exact, with linear interpolation; ``approximate`` takes one pass and bounded memory.

    The value is looked for in counts of buckets: at first of the logarithm, then twice of equal parts of the
    bucket that holds it. What is left has at most some 200,000 different numbers, so no task gets more than that
    of a group, however many values it has.
    """

    q: float = Field(default=0.5, ge=0, le=1)
    approximate: bool = Field(default=False)

    def aggregate(self, col: Column) -> Column:
        return F.percentile_approx(col, self.q) if self.approximate else F.percentile(col, self.q)

    def by_buckets(self, df: DataFrame) -> bool:
        """Whether ``table`` gives the value: of numbers, of which all tables can be read again."""
        return not self.approximate and bool(self.on) and isinstance(field_type(df.schema, self.on), T.NumericType) and not df.isStreaming

    def table(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """A row (_key0, _key1 ..., name) for each group with a value."""
        ks = [f"_key{i}" for i in range(len(keys))]
        own = _rescanned(df.select(*[get_field(df, k).alias(n) for k, n in zip(keys, ks)], get_field(df, self.on).cast("double").alias("v")).filter("v IS NOT NULL"))
        own = own.groupBy(*ks, "v").agg(F.count(F.lit(1)).alias("c")) if ks else own.withColumn("c", F.lit(1).cast("long"))
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        size = F.floor(F.least(F.log(F.abs(v)), F.lit(710.0)) * 44) + 35_000  # 710 for infinity alone
        part = F.when(v == 0, F.lit(0)).when(F.isnan(v), F.lit(BUCKETS * 2)).when(v > 0, size).otherwise(-size)
        linear = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * BUCKETS)).otherwise(F.lit(0))

        def counted(rows: DataFrame, bucket: Column, *more: str) -> DataFrame:
            found = rows.groupBy(*ks, *more, bucket.alias("b")).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            groups = [*ks, *more[:1]]
            return found.withColumn("upto", F.sum("n").over(Window.partitionBy(*groups).orderBy("b")))

        def holding(found: DataFrame) -> DataFrame:
            """The bucket with the row of this rank, counted from 0."""
            before = F.col("upto") - F.col("n")
            return found.filter((before <= F.col("rank")) & (F.col("rank") < F.col("upto"))).select(*ks, "target", "at", (F.col("rank") - before).alias("rank"), "lo", "hi")

        at = (F.sum("n").over(Window.partitionBy(*ks)) - 1) * F.lit(self.q)
        found = counted(own, part).withColumn("at", at)
        here = holding(found.withColumn("target", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).withColumn("rank", F.col("target")))
        for bucket in (linear, linear, v):
            here = here.select(*[F.col(k).alias(f"{k}_") for k in ks], "target", "at", "rank", "lo", "hi")
            inside = (v >= lo) & (v <= hi)
            for k in ks:
                inside = inside & F.col(k).eqNullSafe(F.col(f"{k}_"))
            here = holding(counted(own.join(here if ks else F.broadcast(here), inside), bucket, "target", "at", "rank"))
        ends = here.groupBy(*ks).agg(F.min(F.struct("target", "lo")).alias("a"), F.max(F.struct("target", "lo")).alias("z"), F.first("at").alias("at"))
        a, z = F.col("a.lo"), F.col("z.lo")
        between = (F.col("z.target") - F.col("at")) * a + (F.col("at") - F.col("a.target")) * z
        return ends.select(*ks, F.when(a == z, a).otherwise(between).alias(name))


@components.add("aggregation", "unique")
class Unique(ReduceFn):
    """The distinct values in order; a null among them comes first unless nulls are ignored."""

    def column(self, df: DataFrame) -> Column:
        col = get_field(df, self.on)
        out = F.sort_array(F.collect_set(col))
        if not self.ignore_nulls:
            out = F.when(F.count_if(col.isNull()) > 0, F.concat(F.array(F.lit(None)), out)).otherwise(out)
        return out.alias(self.name)


@components.add("aggregation", "counter")
class Counter(ReduceFn):
    """The ``top_k`` most frequent n-grams of counted lists, as rows (keys, ngram, count, rank)."""

    top_k: int | None = Field(default=None, gt=0, description="Rows a group; all without it")

    def table(self, df: DataFrame, keys: list[str]) -> DataFrame:
        own = df.select(*[get_field(df, k).alias(k) for k in keys], F.explode(get_field(df, self.on)).alias("g"))
        total = own.groupBy(*keys, F.col("g.ngram").alias("ngram")).agg(F.sum("g.count").alias("count"))
        if self.top_k is None:
            return total
        if not keys:
            return total.orderBy(F.desc("count"), "ngram").limit(self.top_k)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "ngram"))
        return total.withColumn("rank", rank).filter(F.col("rank") <= self.top_k).drop("rank")


def aggregate(df: DataFrame, aggregations: list[ReduceFn], groupby: str | list[str] | None = None) -> DataFrame:
    """One row, or one a group; keys and fields may be dotted. Counters are apart: see ``Counter.table``."""
    keys = [groupby] if isinstance(groupby, str) else list(groupby or [])
    for k in keys:
        if field_type(df.schema, k) is None:
            raise ValueError(f"no field {k!r} to group by")
    apart = {i: a for i, a in enumerate(aggregations) if isinstance(a, Quantile) and a.by_buckets(df)}
    hole = lambda a: F.lit(False) if a.ignore_nulls else F.count_if(get_field(df, a.on).isNull()) > 0
    cols = [hole(a).alias(f"_hole{i}") if i in apart else a.column(df) for i, a in enumerate(aggregations)]
    out = df.groupBy(*[get_field(df, k).alias(k) for k in keys]).agg(*cols) if keys else df.agg(*cols)
    if not apart:
        return out
    for i, a in apart.items():
        found, same = a.table(df, keys, f"_quantile{i}"), F.lit(True)
        for j, k in enumerate(keys):
            same = same & F.col(_name(k)).eqNullSafe(F.col(f"_key{j}"))
        out = out.join(found if keys else F.broadcast(found), same, "left").drop(*[f"_key{j}" for j in range(len(keys))])
    value = lambda i, a: F.when(~F.col(f"_hole{i}"), F.col(f"_quantile{i}")).alias(a.name) if i in apart else F.col(_name(a.name))
    return out.select(*[F.col(_name(k)) for k in keys], *[value(i, a) for i, a in enumerate(aggregations)])
