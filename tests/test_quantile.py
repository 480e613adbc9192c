import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.aggregations import aggregate
from corpusflow.plans.registry import components


def quantile(**params):
    return components.get("aggregation", "quantile")(name="m", on="v", **params)


def rows():
    """Groups of close, far, equal, infinite, tiny and missing numbers."""
    r = random.Random(3)
    bits = lambda: struct.unpack("d", r.randbytes(8))[0]
    groups = {
        "any": [bits() for _ in range(801)], "close": [math.nextafter(1.0, 2, steps=r.randrange(60)) for _ in range(400)], "same": [-2.5] * 7, "one": [3.0], "two": [1.0, 2.0], "none": [None] * 3,
        "ends": [math.inf, -math.inf, math.inf, 0.0, math.nan], "tiny": [5e-324 * r.randrange(-9, 9) for _ in range(90)], "prices": [r.randrange(90_000, 10_500_000) / 100 for _ in range(3000)], None: [4.0, None, 6.0, -1e300],
    }
    return [(k, v) for k, vs in groups.items() for v in vs]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.37, 1.0])
def test_quantile_is_exact(spark, q):
    df = spark.createDataFrame(rows(), "k string, v double").repartition(3)
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("v", q).alias("m")).collect()}
    got = {r.k: r.m for r in aggregate(df, [quantile(q=q, ignore_nulls=True)], "k").collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    for part in (df.filter("k = 'prices'"), df.filter("k <> 'ends'"), df.filter("k = 'none'"), df.filter("k = 'nowhere'")):
        assert aggregate(part, [quantile(q=q, ignore_nulls=True)]).first()[0] == part.agg(F.percentile("v", q)).first()[0]


def test_no_task_holds_all_numbers_of_a_group(spark):
    """The old aggregate kept a group's numbers as one state."""
    df = spark.range(200_000).selectExpr("id % 2 AS k", "sqrt(id) AS v")
    for key in (None, "k"):
        plan = aggregate(df, [quantile()], key)._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "ObjectHashAggregate" not in plan
    assert aggregate(df, [quantile()]).first()[0] == (math.sqrt(99_999) + math.sqrt(100_000)) / 2


def test_quantile_of_other_types_and_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (4, "x"), (None, "y"), (9, "y")], "v int, k string")
    other = components.get("aggregation", "count")(name="n")
    assert [tuple(r) for r in aggregate(df, [other, quantile()], "k").orderBy("k").collect()] == [("x", 2, 2.5), ("y", 2, None)]
    assert aggregate(df.selectExpr("cast(v AS decimal(9, 2)) AS v"), [quantile(ignore_nulls=True)]).first()[0] == 4.0
    made = df.withColumn("v", F.pandas_udf(lambda s: s + 1, "double")("v"))
    assert aggregate(made, [quantile(ignore_nulls=True)]).first()[0] == 5.0
