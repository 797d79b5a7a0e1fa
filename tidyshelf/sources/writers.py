"""Writing the clean and the error table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf.operators.columns import conform
from tidyshelf.schemas import CLEAN_SCHEMA, ERROR_SCHEMA
from tidyshelf.sources.publish import Files, publish, replace_tables

BOM = "﻿"
#: Rows of a CSV file at most. Records may span lines, so whoever reads a file reads it in one task.
FILE_ROWS = 20_000


def _writer(df: DataFrame, schema: T.StructType, fmt: str, bom: bool) -> Callable[[str], None]:
    """What writes the table to a folder that does not exist yet."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported output format {fmt!r}; supported: csv, parquet")
    table = conform(df, schema)
    if fmt == "parquet":
        return table.write.parquet
    first = table.columns[0]
    named = table.withColumnRenamed(first, BOM + first) if bom else table
    return (
        named.write.option("header", True).option("encoding", "UTF-8")
        .option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", FILE_ROWS).csv
    )


def write_clean(df: DataFrame, path: str, fmt: str = "csv", bom: bool = True) -> None:
    """The 13 clean columns. CSV has a header, UTF-8 with a byte order mark. ``path`` is replaced once all is written.

    A task writes its rows in order, to as many CSV files as :data:`FILE_ROWS` makes of them.
    """
    replace_tables(df.sparkSession, {path: _writer(df, CLEAN_SCHEMA, fmt, bom)})


def write_errors(df: DataFrame, path: str, fmt: str = "csv", bom: bool = True) -> None:
    """The 6 error columns, written like the clean ones."""
    replace_tables(df.sparkSession, {path: _writer(df, ERROR_SCHEMA, fmt, bom)})


def write_jsonl(df: DataFrame, path: str, run: str | None = None) -> None:
    """Append records as JSON lines; non-ASCII text stays readable and nulls are written.

    With ``run`` the records are those of that run: its folder ``run=...`` is replaced, so a job that is
    repeated adds its rows once, and those of other runs stay.
    """
    if run is None:
        df.write.mode("append").option("ignoreNullFields", False).json(path)
        return
    seen = Observation("records")
    keyed = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("run").json(path)
    if not seen.get["n"]:  # no rows name no partition; what the run had is gone all the same
        folder = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run)
        Files(df.sparkSession).delete(f"{path.rstrip('/')}/run={folder}")


@dataclass(frozen=True)
class ExportResult:
    total: int
    success: int
    errors: int
    success_rate: float


def export_results(
    clean: DataFrame, errors: DataFrame, clean_path: str, error_path: str,
    fmt: str = "csv", bom: bool = True,
) -> ExportResult:
    """Write both tables, then put both in place; the counts are observed on the way, without another pass.

    If either write fails, both old tables stay as they are.
    """
    seen_clean, seen_errors = Observation("clean"), Observation("errors")
    replace_tables(clean.sparkSession, {
        clean_path: _writer(clean.observe(seen_clean, F.count(F.lit(1)).alias("n")), CLEAN_SCHEMA, fmt, bom),
        error_path: _writer(errors.observe(seen_errors, F.count(F.lit(1)).alias("n")), ERROR_SCHEMA, fmt, bom),
    })
    good, bad = seen_clean.get["n"], seen_errors.get["n"]
    total = good + bad
    return ExportResult(total, good, bad, round(good / total * 100, 2) if total else 0.0)


def publish_results(clean: DataFrame, errors: DataFrame, root: str, keep: int = 2) -> str:
    """Both tables as one run below ``root``, made current by one rename; ``read_published`` reads the current run."""
    return publish(clean.sparkSession, root, {"clean": conform(clean, CLEAN_SCHEMA), "errors": conform(errors, ERROR_SCHEMA)}, keep)
