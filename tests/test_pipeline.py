"""Configuration, command line, readers, writers, streaming, and the registered queries."""

import gzip
import json

import pytest
import yaml
from pyspark.sql import functions as F

import __spark_entry__
from corpusflow import cli
from corpusflow.plans import catalog
from corpusflow.plans.config import PipelineConfig
from corpusflow.plans.pipeline import DataPipeline
from corpusflow.plans.registry import components
from corpusflow.streaming.steps import apply_steps, drop_exact_copies

DATA = "/root/testdata/sf0.001"


def config(tmp_path, **more):
    return {
        "name": "p", "input": {"format": "parquet", "path": f"{DATA}/documents.parquet"},
        "processors": [
            {"category": "ingest", "type": "base", "params": {"id_column": "doc_id", "text_column": "text", "source_name_or_column": "source", "other": ["lang"]}},
            {"category": "tag", "type": "length"}, {"category": "tag", "type": "ngrams", "params": {"ngram_size": 1, "on": "text"}, "enabled": True}, {"category": "filter", "type": "exists", "enabled": False, "params": {"on": "nowhere"}},
            {"category": "filter", "type": "value", "params": {"on": "metadata.length.word_count", "value": 50, "comparator": "gte", "semantics": "corrected"}},
        ],
        "aggregations": [{"category": "aggregation", "type": "count", "params": {"name": "n", "on": "id"}}, {"category": "aggregation", "type": "counter", "params": {"name": "top", "on": "metadata.ngrams", "top_k": 2}}],
        "output": {"format": "parquet", "path": str(tmp_path / "out")},
    } | more


def test_end_to_end(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(yaml.safe_dump(config(tmp_path)))
    c = PipelineConfig.from_yaml(p)
    assert c.processors[2].params["on"] == "text"
    out = DataPipeline(c, spark).run()
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert out["n"] == n > 50 and len(out["top"]) == 2
    with pytest.raises(Exception, match="exists"):
        DataPipeline(c, spark).run()
    c.save_yaml(tmp_path / "d.yaml")
    assert PipelineConfig.from_yaml(tmp_path / "d.yaml") == c


def test_grouped_aggregates_to_json(spark, tmp_path):
    c = PipelineConfig.from_dict(config(tmp_path, output=None, aggregation_kwargs={"groupby": "lang", "output_path": str(tmp_path / "a.json")}))
    out = DataPipeline(c, spark).run()
    assert json.load(open(tmp_path / "a.json")) == json.loads(json.dumps(out)) and {r["lang"] for r in out} <= {"de", "en", "es", "fr"}
    assert DataPipeline(PipelineConfig.from_dict(config(tmp_path, output=None, aggregations=None)), spark).run() is None


def test_bad_configurations(spark, tmp_path):
    for bad in ({"processors": [{"category": "tagger", "type": "length"}]}, {"processors": [{"category": "tag", "type": "length", "params": {"x": 1}}]}, {"surprise": 1}, {"aggregations": [{"category": "aggregation", "type": "none"}]}):
        with pytest.raises(ValueError):
            PipelineConfig.from_dict(config(tmp_path) | bad)
    with pytest.raises(ValueError):
        PipelineConfig.from_dict({"name": "no input"})
    p = DataPipeline(PipelineConfig.from_dict(config(tmp_path)), spark)
    for early in (p.process, p.write, p.aggregate):
        with pytest.raises(ValueError):
            early()


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config(tmp_path)))
    assert cli.main(["validate", str(tmp_path / "c.yaml")]) == 0
    (tmp_path / "bad.yaml").write_text("name: x")
    assert cli.main(["validate", str(tmp_path / "bad.yaml")]) == 1
    assert cli.main(["list", "reader"]) == 0 and "parquet" in capsys.readouterr().out
    assert cli.main(["export-schemas", str(tmp_path / "s.json"), "--category", "tag"]) == 0 and "length" in json.load(open(tmp_path / "s.json"))
    assert cli.main(["run", str(tmp_path / "c.yaml"), "--output-path", str(tmp_path / "cli"), "--spark", "batch_size=512", "--spark", "spark.sql.shuffle.partitions=4"]) == 0
    assert spark.read.parquet(str(tmp_path / "cli")).count() > 0
    with cli.silence():
        pass


def reader(kind, **p):
    return components.get("reader", kind)(**p)


def writer(kind, **p):
    return components.get("writer", kind)(**p)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk\nx;y\n1;a\n2;\"b;c\"\n")
    df = reader("csv", delimiter=";", skiprows=1, dtype={"x": "int64"}, usecols=["y", "x"])(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["y", "x"] and [tuple(r) for r in df.collect()] == [("a", 1), ("b;c", 2)]
    (tmp_path / "b.csv").write_text("1,a\n2,b\n")
    assert reader("csv", header=None, names=["n", "s"])(spark, str(tmp_path / "b.csv")).columns == ["n", "s"]
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert reader("jsonl")(spark, str(tmp_path / "*.jsonl.gz")).count() == 2
    assert reader("jsonl", schema_ddl="a long, b string")(spark, str(tmp_path / "c.jsonl.gz")).columns == ["a", "b"]
    (tmp_path / "t.txt").write_bytes("für\nzwei\n".encode("latin-1"))
    assert [r[0] for r in reader("text", encoding="iso-8859-1")(spark, str(tmp_path / "t.txt")).collect()] == ["für", "zwei"]
    (tmp_path / "u.txt").write_text("eins\nzwei")
    assert reader("text")(spark, [str(tmp_path / "u.txt")]).count() == 2
    assert reader("parquet", columns=["doc_id"], batch_size=1024)(spark, f"{DATA}/documents.parquet").columns == ["doc_id"]
    with pytest.raises(ValueError):
        reader("text")(spark, "gopher://x/y")


def test_csv_of_texts(spark, tmp_path):
    rows = [(1, "a\nb"), (2, ""), (3, None), (4, 'say "x", y\r\nz \\'), (5, " lead and trail "), (6, '"'), (7, "tab\tü")]
    writer("csv")(spark.createDataFrame(rows, "i int, t string").repartition(3), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in reader("csv", dtype={"i": "int32"})(spark, str(tmp_path / "c")).collect()) == rows
    for k in range(3):  # lines to skip in each of several files
        (tmp_path / f"s{k}.csv").write_text("junk\n\nx,y\n" + "".join(f"{k},v{j}\n" for j in range(4)))
    got = reader("csv", skiprows=2)(spark, str(tmp_path / "s*.csv"))
    assert got.columns == ["x", "y"] and sorted(tuple(r) for r in got.collect()) == [(str(k), f"v{j}") for k in range(3) for j in range(4)]


def test_steps_are_computed_once_and_source_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = [components.get("tag", "length")(), components.get("filter", "value")(on="metadata.length.word_count", value=5, comparator="gt", if_missing=False, semantics="corrected"), components.get("filter", "value")(on="lang", value="en", if_missing=False, semantics="corrected")]
    out = apply_steps(df, steps)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan or "EqualNullSafe(lang,en)" in plan
    assert 0 < out.count() < df.count()
    long = apply_steps(df, [components.get("format", "spacing")(), components.get("tag", "gopher_quality")(language="en")] * 4)
    assert len(long._jdf.queryExecution().optimizedPlan().toString()) < 200_000  # grows with the steps, not as a power of them


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", [1, 2]), (2, None, [])], "i int, s string, a array<int>")
    writer("parquet", partition_cols="i", compression="zstd", row_group_size=1 << 20)(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and (tmp_path / "p" / "i=1").exists()
    with pytest.raises(Exception, match="exists"):
        writer("parquet")(df, str(tmp_path / "p"))
    writer("parquet", overwrite=True, max_rows_per_file=1)(df.coalesce(1), str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 2
    writer("jsonl", force_ascii=True)(df.coalesce(1), str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("*.json")).read_text()
    assert "\\u00" in text.lower() and json.loads(text.splitlines()[0])["a"] == [1, 2]
    writer("csv", delimiter=";", header=["x", "y", "z"])(df.coalesce(1), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text().splitlines()[0] == "x;y;z"
    writer("csv", include_header=False)(df.coalesce(1), str(tmp_path / "d"))
    assert next((tmp_path / "d").glob("*.csv")).read_text().startswith("1,")


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d e")], "id int, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("id int, text string, ts timestamp").parquet(str(src))
    steps = [components.get("tag", "length")(), components.get("filter", "value")(on="metadata.length.word_count", value=1, comparator="gt", if_missing=False)]
    out = drop_exact_copies(apply_steps(stream, steps), "ts")
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("streamed").count() == 2


def test_entry_and_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["tag_gopher_quality_en", "tag_gopher_quality_de", "tag_repetition_top", "tag_ocr_words", "filter_gopher_quality_compat", "filter_gopher_quality_corrected"])
def test_queries_keep_rows_without_text(spark, monkeypatch, name):
    seen = []
    rows = [(0, "en", None), (1, "en", ""), (2, "en", " \n"), (3, "en", "The cat and the dog, to be with you.")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    monkeypatch.setattr(catalog, "docs", lambda spark, sf_dir: df)
    if name.startswith("filter"):
        monkeypatch.setattr(catalog, "apply_steps", lambda given, steps: seen.append(given.count()) or given)
    got = catalog.QUERIES[name](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3] and seen in ([], [4])


def test_ftfy_over_documents(spark, monkeypatch):
    long = "Ã¼ber &amp; it " * 20000
    df = spark.createDataFrame([(0, long), (1, None), (2, "")], "doc_id long, text string")
    rows = catalog.QUERIES["format_ftfy_documents"](spark, DATA).count()
    assert rows == catalog.docs(spark, DATA).count() > 0
    monkeypatch.setattr(catalog, "docs", lambda spark, sf_dir: df)
    got = {r["doc_id"]: r["text"] for r in catalog.QUERIES["format_ftfy_documents"](spark, DATA).collect()}
    assert got == {0: "über & it " * 20000, 1: None, 2: ""}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    norm = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    assert norm(got.select(*cols).collect()) == norm(rel.select(*[f'"{c}"' for c in cols]).fetchall())
