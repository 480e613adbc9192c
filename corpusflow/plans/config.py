"""Pipeline configurations: pydantic models, from YAML or dictionaries."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml
from pydantic import BaseModel, ConfigDict, Field, model_validator

import corpusflow.operators  # noqa: F401  (registers the components)
from corpusflow.plans.registry import components


class CoreLoader(yaml.SafeLoader):
    """YAML 1.2's booleans: a key ``on`` is text."""


CoreLoader.yaml_implicit_resolvers = {c: [x for x in own if x[0] != "tag:yaml.org,2002:bool"] for c, own in yaml.SafeLoader.yaml_implicit_resolvers.items()}
CoreLoader.add_implicit_resolver("tag:yaml.org,2002:bool", __import__("re").compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


class SparkConfig(BaseModel):
    """Resource knobs and what they become in Spark."""

    model_config = ConfigDict(extra="forbid")
    target_max_block_size_mb: int = Field(default=128, gt=0, description="spark.sql.files.maxPartitionBytes")
    override_num_blocks: int | None = Field(default=None, gt=0, description="Partitions after reading")
    concurrency: int | None = Field(default=None, gt=0, description="Partitions, and so files, when writing")
    num_cpus_per_task: float = Field(default=1.0, gt=0, description="spark.task.cpus; set when the session starts")
    memory_per_task_mb: int | None = Field(default=None, gt=0, description="Accepted; executors set memory")
    batch_size: int | None = Field(default=None, gt=0, description="spark.sql.execution.arrow.maxRecordsPerBatch")
    min_rows_per_file: int | None = Field(default=None, gt=0, description="Merge small output files (a hint: Spark sizes them in bytes)")
    conf: dict[str, str] = Field(default_factory=dict, description="Further Spark settings")

    def settings(self) -> dict[str, str]:
        out = {"spark.sql.files.maxPartitionBytes": f"{self.target_max_block_size_mb}m"}
        if self.batch_size:
            out["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(self.batch_size)
        return out | self.conf


class StepConfig(BaseModel):
    model_config = ConfigDict(extra="forbid")
    category: str
    type: str
    params: dict[str, Any] = Field(default_factory=dict)
    enabled: bool = True


class ConnectorConfig(BaseModel):
    model_config = ConfigDict(extra="forbid")
    path: str | list[str]
    format: str
    params: dict[str, Any] = Field(default_factory=dict)


class PipelineConfig(BaseModel):
    model_config = ConfigDict(extra="forbid")
    name: str
    description: str | None = None
    input: ConnectorConfig
    processors: list[StepConfig] = Field(default_factory=list)
    process_kwargs: dict[str, Any] = Field(default_factory=dict, description="Parameters for all processors that know them")
    output: ConnectorConfig | None = None
    aggregations: list[StepConfig] | None = None
    aggregation_kwargs: dict[str, Any] = Field(default_factory=dict, description="groupby and output_path")
    spark_config: SparkConfig = Field(default_factory=SparkConfig)

    @classmethod
    def from_yaml(cls, path: str | Path) -> PipelineConfig:
        with open(path) as f:
            return cls.model_validate(yaml.load(f, Loader=CoreLoader))  # a safe loader

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> PipelineConfig:
        return cls.model_validate(data)

    def save_yaml(self, path: str | Path) -> None:
        with open(path, "w") as f:
            yaml.safe_dump(self.model_dump(exclude_unset=True, exclude_none=True), f, sort_keys=False)

    @model_validator(mode="after")
    def _known(self) -> PipelineConfig:
        for s in [*self.processors, *(self.aggregations or [])]:
            if not components.has(s.category, s.type):
                raise ValueError(f"unknown component {s.category}.{s.type}")
            try:
                components.validate_config(s.category, s.type, s.params)
            except ValueError as e:
                raise ValueError(f"bad parameters of {s.category}.{s.type}: {e}") from e
        return self
