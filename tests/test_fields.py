"""Dotted paths, truthiness and the registry."""

import json

import pytest
from pydantic import BaseModel
from pyspark.sql import functions as F

from corpusflow.functions.fields import field_type, get_field, is_missing, set_field
from corpusflow.plans.registry import Registry, components


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "x", ("en", 0.5)), (2, "", None)], "id int, text string, m struct<lang:string,score:double>")


def test_get(df):
    assert [r[0] for r in df.select(get_field(df, "m.lang")).collect()] == ["en", None]
    for path in ("", "none", "m.none", "text.x", "m.lang.deep"):
        assert df.select(get_field(df, path).alias("v")).first()[0] is None


def test_set(df):
    out = set_field(df, "m.score", F.lit(2.0))
    assert [tuple(r["m"]) for r in out.collect()] == [("en", 2.0), (None, 2.0)]
    out = set_field(df, "a.b.c-d", F.lit(7))
    assert out.select(get_field(out, "a.b.c-d")).first()[0] == 7
    out = set_field(df, "m.deep.er", F.lit("z"))
    assert out.first()["m"].asDict(True) == {"lang": "en", "score": 0.5, "deep": {"er": "z"}}
    assert set_field(df, "text", F.lit("new")).first()["text"] == "new"
    with pytest.raises(TypeError):
        set_field(df, "text.inner", F.lit(1))
    with pytest.raises(TypeError):
        set_field(df, "m.lang.inner", F.lit(1))
    with pytest.raises(ValueError):
        set_field(df, "", F.lit(1))
    assert field_type(df.schema, "m.score").typeName() == "double"


def test_missing(spark):
    df = spark.createDataFrame([("", 0, 0.0, False, [], None), ("a", 1, float("nan"), True, [1], (1,)), (None,) * 6], "s string, i int, d double, b boolean, a array<int>, t struct<x:int>")
    for c in df.columns:
        assert [r[0] for r in df.select(is_missing(df, c)).collect()] == ([True] if c != "t" else [True]) + [False, True]
    assert df.select(is_missing(df, "nowhere")).first()[0] is True


def test_registry(tmp_path):
    r = Registry()

    @r.add("tag", "one")
    class One(BaseModel):
        x: int = 1

    assert r.has("tag", "one") and not r.has("tag", "two") and not r.has("no", "one")
    assert r.get("tag", "one") is One and r.categories() == ["tag"] and r.components("tag") == ["one"]
    assert r.validate_config("tag", "one", {}) == {"x": 1}
    for bad in (("tag", "two"), ("no", "one")):
        with pytest.raises(ValueError):
            r.get(*bad)
    r.export_schemas(str(tmp_path / "s.json"))
    assert json.load(open(tmp_path / "s.json"))["tag"]["one"]["$id"] == "corpusflow://tag/one"
    r.add("tag", "one")(int)
    assert r.get("tag", "one") is int
    with pytest.raises(ValueError):
        r.get_schema("tag", "one")


def test_all_components_are_registered():
    import corpusflow.operators  # noqa: F401

    want = {"reader": 4, "writer": 3, "ingest": 1, "extract": 3, "format": 5, "filter": 8, "tag": 10, "aggregation": 10}
    assert {c: len(components.components(c)) for c in components.categories()} == want
    assert all(components.get_all_schemas(c) for c in want)
