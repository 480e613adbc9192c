from pyspark.sql import functions as F

from corpusflow.operators.basic import ExprFilter
from corpusflow.plans import base
from corpusflow.plans.base import MapFn, apply_steps, filters_first
from corpusflow.plans.registry import components


def step(category, kind, **params):
    return components.get(category, kind)(**params)


def names(steps):
    return [f"{type(s).__name__}:{s.to if isinstance(s, MapFn) else s.on}" for s in steps]


def test_filters_come_as_early_as_they_can():
    tags = [step("tag", "language"), step("tag", "length"), step("tag", "ocr_quality")]
    length = step("filter", "token_count", on="metadata.length.word_count")
    assert names(filters_first([*tags, step("filter", "language"), length])) == [
        "LanguageTagger:metadata.language", "LanguageFilter:metadata.language", "Length:metadata.length", "TokenCountFilter:metadata.length.word_count", "OCRQuality:metadata.ocr_quality"]
    for still in (ExprFilter(expr="true"), step("filter", "exists", on="metadata")):  # read what any step may write
        assert filters_first([*tags, still]) == [*tags, still]
    for learner in (step("tag", "perplexity"), step("format", "deduplication")):  # others' rows count there
        assert filters_first([tags[0], learner, step("filter", "language")])[1] is learner


def test_what_comes_before_a_learning_step_runs_once(spark, monkeypatch):
    ran, texts = spark.sparkContext.accumulator(0), [f"the cat and the dog sat on mat {i}" for i in range(40)] + ["x y z"] * 10

    class Counted(MapFn):
        def column(self, df):
            @F.udf("string")
            def seen(t):
                ran.add(1)
                return t

            return seen(self.text(df))

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    steps = [Counted(), step("tag", "language"), step("tag", "length"), step("filter", "language"), step("tag", "perplexity"), step("filter", "token_count", on="metadata.length.word_count", min_tokens=2)]
    got = {r.id: (r.text, r.metadata, r.perplexity) for r in apply_steps(df, steps).collect()}
    assert ran.value == 50 and len(got) == 40
    monkeypatch.setattr(base, "filters_first", list)
    monkeypatch.setattr(base, "materialize", lambda df, name: df)
    assert got == {r.id: (r.text, r.metadata, r.perplexity) for r in apply_steps(df, steps).collect()}
