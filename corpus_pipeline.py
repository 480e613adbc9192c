"""A corpus pipeline of five stages: each takes the documents that the stage before kept.

All stages but the last return the columns of ``documents``; each is written as
Parquet in the shared folder and reread as the next one's input, so a lost executor
costs a reread. SQL can't express the classifier or the alignments, so there is no
oracle; tests compare each stage with a brute-force version.

Defined cases: null texts count as empty; null ids pass the join stages untouched;
rows that share the kept id of a group of near duplicates all stay; a document
whose lines all go keeps its row with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from corpusflow.llm.common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, accepts."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that many documents share; ``n_chars`` follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = line_dedup.dedup_lines(docs, keep=rest).withColumnRenamed("kept", "text")
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id."""
    gone = jaccard_join.similar_documents(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with which no test item of ``benchmark`` aligns."""
    return decontaminate.drop_leaking(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their length bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", no_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
