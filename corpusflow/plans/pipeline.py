"""Runs a configuration: one DataFrame plan from the reader to the writer."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusflow.operators.aggregations import Counter, aggregate
from corpusflow.plans.base import FilterFn, MapFn, apply_steps
from corpusflow.plans.config import PipelineConfig
from corpusflow.plans.registry import components


class DataPipeline:
    def __init__(self, config: PipelineConfig, spark: SparkSession | None = None):
        self.config = config
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.dataset: DataFrame | None = None
        for k, v in config.spark_config.settings().items():
            self.spark.conf.set(k, v)

    def read(self, **params: Any) -> DataFrame:
        c = self.config.input
        reader = components.get("reader", c.format)(**(c.params | params))
        df = reader(self.spark, c.path)
        n = self.config.spark_config.override_num_blocks
        self.dataset = df.repartition(n) if n else df
        return self.dataset

    def process(self, **params: Any) -> DataFrame:
        if self.dataset is None:
            raise ValueError("there is no data yet: call read() first")
        common = self.config.process_kwargs | params
        steps = []
        for s in self.config.processors:
            if not s.enabled:
                continue
            cls = components.get(s.category, s.type)
            if not issubclass(cls, (MapFn, FilterFn)):
                raise ValueError(f"{s.category}.{s.type} is neither a map nor a filter")
            steps.append(cls(**({k: v for k, v in common.items() if k in cls.model_fields} | s.params)))
        self.dataset = apply_steps(self.dataset, steps)
        return self.dataset

    def write(self, **params: Any) -> None:
        if self.dataset is None:
            raise ValueError("there is no data yet: call read() first")
        c = self.config.output
        if c is None:
            raise ValueError("the configuration has no output")
        df, conf = self.dataset, self.config.spark_config
        if conf.min_rows_per_file:
            df = df.hint("rebalance")  # small partitions are merged when their sizes are known; nothing is computed to count rows
        if conf.concurrency:
            df = df.coalesce(conf.concurrency)
        components.get("writer", c.format)(**(c.params | params))(df, c.path)

    def aggregate(self, output_path: str | None = None, groupby: str | list[str] | None = None) -> dict | list[dict] | None:
        """A dictionary, or one a group; counters add a list of [n-gram, count] under their name."""
        if self.dataset is None:
            raise ValueError("there is no data yet: call read() first")
        steps = [components.get(s.category, s.type)(**s.params) for s in self.config.aggregations or [] if s.enabled]
        if not steps:
            return None
        keys = [groupby] if isinstance(groupby, str) else list(groupby or [])
        plain = [s for s in steps if not isinstance(s, Counter)]
        rows: dict[tuple, dict] = {}
        if plain:
            for r in aggregate(self.dataset, plain, keys).collect():  # one row a group: the caller's result
                d = r.asDict(recursive=True)
                rows[tuple(d[k] for k in keys)] = d
        for c in steps:
            if isinstance(c, Counter):
                for r in c.table(self.dataset, keys).collect():
                    at = tuple(r[k] for k in keys)
                    rows.setdefault(at, dict(zip(keys, at))).setdefault(c.name, []).append([r["ngram"], r["count"]])
        out: dict | list[dict] | None = list(rows.values()) if keys else next(iter(rows.values()), None)
        if output_path and out:
            text = json.dumps(out, indent=4, sort_keys=True, default=str)
            path = self.spark._jvm.org.apache.hadoop.fs.Path(output_path)
            stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
            stream.write(bytearray(text.encode()))
            stream.close()
        return out or None

    def run(self, read_kwargs: dict | None = None, process_kwargs: dict | None = None, write_kwargs: dict | None = None, aggregate_kwargs: dict | None = None) -> dict | list[dict] | None:
        """Read, process, write and aggregate; what is both written and aggregated is computed once."""
        self.read(**(read_kwargs or {}))
        self.process(**(process_kwargs or {}))
        both = self.config.output is not None and bool(self.config.aggregations)
        if both:
            self.dataset = self.dataset.persist()
        try:
            if self.config.output is not None:
                self.write(**(write_kwargs or {}))
            return self.aggregate(**(self.config.aggregation_kwargs | (aggregate_kwargs or {})))
        finally:
            if both:
                self.dataset.unpersist()
