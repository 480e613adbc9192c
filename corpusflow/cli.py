"""Command line: run, list, validate and export-schemas."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager

from corpusflow.plans.config import PipelineConfig
from corpusflow.plans.pipeline import DataPipeline
from corpusflow.plans.registry import components


@contextmanager
def silence(level: int = logging.CRITICAL) -> Iterator[None]:
    """No log records up to a level."""
    before = logging.root.manager.disable
    logging.disable(level)
    try:
        yield
    finally:
        logging.disable(before)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusflow")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a pipeline")
    run.add_argument("config_path")
    run.add_argument("--input-path")
    run.add_argument("--output-path")
    run.add_argument("--spark", action="append", default=[], metavar="KEY=VALUE", help="a field of spark_config, or a Spark setting")
    run.add_argument("--log-level", default="INFO")
    ls = sub.add_parser("list", help="list components")
    ls.add_argument("category", nargs="?")
    va = sub.add_parser("validate", help="validate a configuration")
    va.add_argument("path")
    ex = sub.add_parser("export-schemas", aliases=["export_schemas"], help="write the JSON schemas of all parameters")
    ex.add_argument("output_path")
    ex.add_argument("--category")
    a = p.parse_args(argv)
    if a.command == "run":
        logging.basicConfig(level=a.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s", stream=sys.stdout)
        config = PipelineConfig.from_yaml(a.config_path)
        if a.input_path:
            config.input.path = a.input_path
        if a.output_path and config.output:
            config.output.path = a.output_path
        fields = type(config.spark_config).model_fields
        for k, v in (x.split("=", 1) for x in a.spark):
            if k in fields and k != "conf":
                config.spark_config = type(config.spark_config).model_validate(config.spark_config.model_dump() | {k: v})
            else:
                config.spark_config.conf[k] = v
        print(f"Running {config.name}")
        print(DataPipeline(config).run())
    elif a.command == "list":
        for c in [a.category] if a.category else components.categories():
            print(c)
            for name in components.components(c):
                print(f"  {name}")
    elif a.command == "validate":
        try:
            print(f"valid: {PipelineConfig.from_yaml(a.path).name}")
        except (ValueError, OSError) as e:
            print(f"invalid: {e}", file=sys.stderr)
            return 1
    else:
        components.export_schemas(a.output_path, a.category)
    return 0


if __name__ == "__main__":
    sys.exit(main())
