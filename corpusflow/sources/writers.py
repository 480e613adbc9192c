"""Writers: Parquet, JSON lines and CSV directories."""

from __future__ import annotations

from pydantic import Field
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.plans.base import Component
from corpusflow.plans.registry import components
from corpusflow.sources.readers import resolve


class Writer(Component):
    overwrite: bool = Field(default=False, description="Replace what lies at the path; else it is an error")
    max_rows_per_file: int | None = Field(default=None, gt=0, description="Rows after which a task opens another file")

    def save(self, df: DataFrame, path: str) -> None:
        raise NotImplementedError

    def writer(self, df: DataFrame):
        w = df.write.mode("overwrite" if self.overwrite else "errorifexists")
        return w.option("maxRecordsPerFile", self.max_rows_per_file) if self.max_rows_per_file else w

    def __call__(self, df: DataFrame, path: str) -> None:
        self.save(df, resolve(df.sparkSession, path)[0])


@components.add("writer", "parquet")
class ParquetWriter(Writer):
    compression: str = Field(default="snappy", description="Codec")
    row_group_size: int | None = Field(default=None, gt=0, description="Bytes of a row group")
    partition_cols: str | list[str] | None = Field(default=None, description="Columns that become directories")

    def save(self, df: DataFrame, path: str) -> None:
        w = self.writer(df).option("compression", self.compression)
        if self.row_group_size:
            w = w.option("parquet.block.size", self.row_group_size)
        if self.partition_cols:
            w = w.partitionBy(*([self.partition_cols] if isinstance(self.partition_cols, str) else self.partition_cols))
        w.parquet(path)


@components.add("writer", "jsonl")
class JSONLWriter(Writer):
    lines_delimiter: str | None = Field(default=None, description="End of a line")
    force_ascii: bool = Field(default=False, description="Write other characters as escapes")

    def save(self, df: DataFrame, path: str) -> None:
        w = self.writer(df).option("ignoreNullFields", False)
        if self.lines_delimiter:
            w = w.option("lineSep", self.lines_delimiter)
        if self.force_ascii:
            w = w.option("writeNonAsciiCharacterAsCodePoint", True)
        w.json(path)


@components.add("writer", "csv")
class CSVWriter(Writer):
    delimiter: str = Field(default=",", description="Field separator")
    header: list[str] | None = Field(default=None, description="Other names for the columns")
    include_header: bool = Field(default=True, description="Write the names")
    escape_char: str = Field(default='"', description="Escape inside quotes")
    quote_char: str = Field(default='"', description="Quote")

    def save(self, df: DataFrame, path: str) -> None:
        nested = (T.StructType, T.ArrayType, T.MapType)
        df = df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])
        df = df.toDF(*self.header) if self.header else df
        self.writer(df).options(sep=self.delimiter, header=self.include_header, escape=self.escape_char, quote=self.quote_char, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
