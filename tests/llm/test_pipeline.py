"""The pipeline's stages over the smallest tables and over hard rows."""

import corpus_pipeline
from corpusflow.llm import decontaminate, quality
from tests.llm.test_documents import brute_jaccard, brute_lines, corpus

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, DATA).cache()
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before.count()
        ids, old = {r[0] for r in kept.select("doc_id").collect()}, [tuple(r) for r in before.select("doc_id", "text").collect()]
        if name == "quality classifier":
            bad = {r[0] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 0").select("doc_id").collect()}
            gone = {i for i, _ in old} - ids
            assert len(gone & bad) >= 0.75 * len(bad & {i for i, _ in old})  # some 60 documents to learn from here
        if name == "line dedup":
            assert sorted(tuple(r) for r in kept.select("doc_id", "text").collect()) == sorted((i, t) for i, _, _, t in brute_lines(old))
            assert kept.filter("n_chars <> length(text)").count() == 0
        if name == "n-gram Jaccard join":
            assert ids == {c for _, _, _, c in brute_jaccard(old)}
        if name == "benchmark decontamination":
            words = {i: " ".join(decontaminate.tokens(t)) for i, t in old}
            items = [" ".join(decontaminate.tokens(t)) for _, t in bench]
            assert not any(x in words[i] for i in ids for x in items if x)
            assert {i for i, w in words.items() if any(x in w for x in items if x)} <= {i for i, _ in old} - ids
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    want = sorted((r["doc_id"], p, min(2048, n - p)) for r in kept.collect() for n in [len((r["text"] or "").encode().split())] for p in range(0, n, 2048))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in last) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_quality_stage_held_out(spark):
    """With some hundred labels: documents that the fit hasn't seen."""
    d = "/root/testdata/sf0.01"
    kept = {r[0] for r in corpus_pipeline.good_quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d).select("doc_id").collect()}
    held = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if quality.is_held_out(r["doc_id"])]
    good, bad = [r["doc_id"] for r in held if r["quality"] == 1], [r["doc_id"] for r in held if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i not in kept for i in bad) >= 0.9 * len(bad)


def test_stages_on_hard_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, DATA)
            df.count()


def test_rows_that_share_the_kept_id_stay(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(1, t), (1, t), (2, t + " x"), (3, "another text of its own, quite short"), (None, t)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.no_near_duplicates(spark, docs, DATA).select("doc_id").collect()
    assert sorted((r[0] for r in got), key=repr) == [1, 1, 3, None]


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert quality.is_held_out(None) is False
