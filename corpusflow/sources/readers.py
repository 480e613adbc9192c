"""Readers: Parquet, JSON lines, CSV and text, from any file system Spark knows."""

from __future__ import annotations

import csv
import os
from typing import Any

import pyarrow as pa
from pydantic import Field
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.plans.base import Component
from corpusflow.plans.registry import components

_KINDS = {"int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float", "str": "string", "object": "string", "bool": "boolean"}


def configure_s3(spark: SparkSession) -> None:
    """Hand the usual AWS variables of the environment to the s3a file system."""
    conf = spark._jsc.hadoopConfiguration()
    for env, key in (("AWS_ACCESS_KEY_ID", "access.key"), ("AWS_SECRET_ACCESS_KEY", "secret.key"), ("AWS_ENDPOINT_URL", "endpoint")):
        if os.environ.get(env):
            conf.set(f"fs.s3a.{key}", os.environ[env])
    if os.environ.get("AWS_SECURE_SCHEME"):
        conf.set("fs.s3a.connection.ssl.enabled", str(os.environ["AWS_SECURE_SCHEME"].lower() not in ("http", "0", "false")).lower())


def resolve(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Paths with s3 mapped to s3a; other schemes than file and s3 are refused."""
    out = []
    for p in [path] if isinstance(path, str) else path:
        scheme = p.split("://")[0] if "://" in p else "file"
        if scheme not in ("file", "s3", "s3a"):
            raise ValueError(f"no file system for {scheme}://")
        if scheme != "file":
            configure_s3(spark)
            p = "s3a://" + p.split("://", 1)[1]
        out.append(p)
    return out


class Reader(Component):
    select: list[str] | None = Field(default=None, description="Columns to read (all by default)")

    def load(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        raise NotImplementedError

    def __call__(self, spark: SparkSession, path: str | list[str]) -> DataFrame:
        df = self.load(spark, resolve(spark, path))
        return df.select(*self.select) if self.select else df


@components.add("reader", "parquet")
class ParquetReader(Reader):
    columns: list[str] | None = Field(default=None, description="Columns to read; the scan reads no others")
    batch_size: int | None = Field(default=None, gt=0, description="Rows in a vectorised batch")

    def load(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        if self.batch_size:
            spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(self.batch_size))
        df = spark.read.parquet(*paths)
        return df.select(*self.columns) if self.columns else df


@components.add("reader", "jsonl")
class JSONLReader(Reader):
    schema_ddl: str | None = Field(default=None, description="Schema; without it the files are read twice")

    def load(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        reader = spark.read.schema(self.schema_ddl) if self.schema_ddl else spark.read
        return reader.json(paths)


def _after(skip: int):
    """The lines of each file but the first ones; the lines of a split come in order and in one task."""

    def run(batches):
        own, seen = None, 0
        for b in batches:
            keep = []
            for path, start in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (path, start) != own:
                    own, seen = (path, start), 0
                seen += 1
                keep.append(start > 0 or seen > skip)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["v"])

    return run


@components.add("reader", "csv")
class CSVReader(Reader):
    delimiter: str = Field(default=",", description="Field separator")
    header: int | bool | None = Field(default=0, description="Whether the first line has names (0 or true)")
    names: list[str] | None = Field(default=None, description="Column names")
    dtype: dict[str, str] | None = Field(default=None, description="Types by column")
    usecols: list[str] | None = Field(default=None, description="Columns to keep")
    skiprows: int | None = Field(default=None, ge=0, description="Lines of each file to skip first; a record is then a line")
    multi_line: bool = Field(default=True, description="Whether fields may hold line ends; without it large files are split among tasks")

    def load(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        headed = self.header is not None and self.header is not False
        # an unquoted empty field is null, a quoted one is an empty string
        options: dict[str, Any] = {"sep": self.delimiter, "quote": '"', "escape": '"', "multiLine": self.multi_line, "emptyValue": "", "nullValue": "\0"}
        if self.skiprows:
            lines = spark.read.text(paths)
            top = [r[0] for r in spark.read.text(lines.inputFiles()[0]).head(self.skiprows + 1)]
            first = next(csv.reader(top[self.skiprows :], delimiter=self.delimiter), [])
            names = self.names or (first if headed else [f"_c{i}" for i in range(len(first))])
            rest = lines.select("value", "_metadata.file_path", "_metadata.file_block_start").mapInArrow(_after(self.skiprows + headed), "v string").filter("v <> ''")
            df = rest.select(F.from_csv("v", ", ".join(f"`{n}` string" for n in names), {k: str(v) for k, v in options.items()}).alias("r")).select("r.*")
        else:
            df = spark.read.options(header=headed, **options).csv(paths)
            df = df.toDF(*self.names) if self.names else df
        for c, kind in (self.dtype or {}).items():
            df = df.withColumn(c, F.col(f"`{c}`").cast(_KINDS.get(kind, kind)))
        return df.select(*self.usecols) if self.usecols else df


@components.add("reader", "text")
class TextReader(Reader):
    encoding: str = Field(default="utf-8", description="Encoding of the files")

    def load(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        if self.encoding.lower().replace("-", "") in ("utf8", "ascii", "usascii"):
            return spark.read.text(paths).withColumnRenamed("value", "text")
        files = spark.read.format("binaryFile").load(paths).select(F.decode("content", self.encoding).alias("t"))
        lines = F.split(F.regexp_replace("t", "\r?\n$", ""), "\r?\n", -1)
        return files.filter("t <> ''").select(F.explode(lines).alias("text"))
