"""Reading listing files as string tables with an explicit order."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.operators.columns import fill_missing

ORDER = "src_ord"
#: A file of Spark's writers: which of its task's files it is stands behind ``-c``, in three digits or more.
_PART = r"(?<=/part-\d{5,9}-[0-9a-f-]{36}-c)(\d{3,6})(?=[.][^/]*$)"


def _csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    return (
        spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multiline)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def _first_keys(spark: SparkSession, files: list[str]) -> list[str]:
    """Keys of the first record of the first file that has one.

    The file comes in pieces that end in a closing brace, as many as the record takes.
    """
    for path in files:
        text, held, enough = "", 0, 1
        for piece in spark.read.option("lineSep", "}").text(path).toLocalIterator():
            text, held = f"{text}{piece[0]}}}", held + 1
            if held >= enough:
                enough = held * 3 // 2 + 1
                try:
                    record, _ = json.JSONDecoder().raw_decode(text.lstrip("\ufeff \t\r\n["))
                except ValueError:
                    continue
                return list(record) if isinstance(record, dict) else []
        try:
            record, _ = json.JSONDecoder().raw_decode(text.lstrip("\ufeff \t\r\n["))
            return list(record) if isinstance(record, dict) else []
        except ValueError:
            continue
    return []


def _json(spark: SparkSession, path: str, multiline: bool, columns: list[str] | None) -> DataFrame:
    reader = spark.read.option("multiLine", multiline).option("primitivesAsString", True)
    if columns:
        return reader.schema(", ".join(f"`{c}` STRING" for c in columns)).json(path)
    df = reader.json(path)
    # schema inference sorts the names; put those of the first record back in their order
    first = [k for k in _first_keys(spark, sorted(df.inputFiles())) if k in df.columns]
    names = first + [c for c in df.columns if c not in first]
    plain = {n for n, t in df.dtypes if t == "string"}
    return df.select(*[
        (F.col(f"`{n}`") if n in plain else F.to_json(f"`{n}`")).alias(n) for n in names
    ])


FORMATS = {
    ".csv": lambda spark, path, multiline, columns: _csv(spark, path, multiline),
    ".json": lambda spark, path, multiline, columns: _json(spark, path, True, columns),
    ".jsonl": lambda spark, path, multiline, columns: _json(spark, path, False, columns),
}


def read_listings(
    spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """A file or folder as a table of strings plus ``src_ord``; missing values are empty texts.

    The format comes from the suffix (``.csv``, ``.json``, ``.jsonl``) unless ``fmt`` names it.
    ``src_ord`` is (file, offset of the split, row), so it follows the file however it is split, and the
    files of one writing task follow each other by number, also beyond the thousandth. CSV
    records may span lines; ``multiline=False`` lets Spark split large CSV files that have none
    such. Columns of JSON come in the order of the first record of the first file by path, then by
    name; ``columns`` names them instead and saves the pass that looks for them. JSON nulls are empty texts, not the words ``None`` or ``nan`` (deviation).
    """
    suffix = f".{fmt.lstrip('.')}" if fmt else PurePosixPath(path.rstrip("/")).suffix
    reader = FORMATS.get(suffix.lower())
    if reader is None:
        raise ValueError(f"unsupported file type {suffix!r}; supported: {', '.join(sorted(FORMATS))}")
    try:
        df = reader(spark, path, multiline, columns)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"input not found: {path}") from error
        raise
    names = [c for c in (columns or df.columns) if c != "_corrupt_record"]
    if not names:
        raise ValueError(f"no usable data in {path}")
    file = F.col("_metadata.file_path")
    order = F.struct(
        F.regexp_replace(file, _PART, "").alias("file"),
        F.regexp_extract(file, _PART, 1).try_cast("int").alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = df.select(*[F.col(f"`{c}`") for c in names], order.alias(ORDER))
    return fill_missing(ordered, na_tokens=suffix.lower() == ".csv")


def require_rows(df: DataFrame) -> DataFrame:
    """Reject a table without columns or rows."""
    if not [c for c in df.columns if c != ORDER] or df.isEmpty():
        raise ValueError("the input has no usable data")
    return df
