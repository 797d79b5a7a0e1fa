"""Listing files in, clean and error tables out: ``spark-submit`` this file, or ``python -m tidyshelf``."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from importlib import import_module

from pyspark.sql import SparkSession

from tidyshelf.config import PipelineConfig
from tidyshelf.plans.jobs import run_pipeline


def named(path: str) -> Callable:
    """The function that ``module:function`` names; its module must be importable on the workers too."""
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidyshelf", description=__doc__)
    parser.add_argument("--input", required=True, help="CSV, JSON or JSON lines file or folder")
    parser.add_argument("--output", default="clean_products")
    parser.add_argument("--errors", default="errors")
    parser.add_argument("--extractor", required=True, help="module:function, asked once per row and attempt")
    parser.add_argument("--limit", type=int, help="only the first so many rows")
    parser.add_argument("--format", dest="fmt", help="csv, json or jsonl, if the suffix does not tell")
    parser.add_argument("--output-format", default="csv")
    parser.add_argument("--threshold", type=float, default=0.5)
    parser.add_argument("--retries", type=int, default=3)
    parser.add_argument("--template", help="prompt template file")
    parser.add_argument("--columns", help="comma-separated input columns, in order")
    parser.add_argument("--scan-partitions", type=int)
    parser.add_argument("--extractor-partitions", type=int)
    parser.add_argument("--ledger", help="folder that records answers; started again, the job asks for the others only")
    parser.add_argument("--in-flight", type=int, default=1, help="open calls per task")
    parser.add_argument("--calls-per-second", type=float, help="calls that may start per second, in all tasks")
    parser.add_argument("--split-lines", action="store_true", help="no CSV record spans lines: files may be split")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tidyshelf").getOrCreate()
    run_pipeline(spark, PipelineConfig(
        a.input, a.output, a.errors, a.fmt, a.limit, a.retries, a.threshold, a.template, a.extractor_partitions, a.output_format,
        multiline=not a.split_lines, columns=tuple(a.columns.split(",")) if a.columns else None, scan_partitions=a.scan_partitions,
        ledger_path=a.ledger, in_flight=a.in_flight, calls_per_second=a.calls_per_second,
    ), named(a.extractor)).show()


if __name__ == "__main__":
    main()
