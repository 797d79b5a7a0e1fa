"""Choosing, merging and conforming columns; row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyshelf import lexicon as lx
from tidyshelf.functions.text import has_text, py_strip
from tidyshelf.schemas import RAW_SCHEMA

TARGET = "raw_description"


def pick_description_column(df: DataFrame) -> DataFrame:
    """Rename the first column with ``description`` in its name, else the first, to the target.

    A column already named like the target but not picked is dropped (names stay unique).
    """
    names = [c for c in df.columns if c != "src_ord"]
    if not names:
        raise ValueError("the table has no usable columns")
    chosen = next((c for c in names if "description" in c.lower()), names[0])
    if chosen == TARGET:
        return df
    return df.drop(TARGET).withColumnRenamed(chosen, TARGET)


def fill_missing(df: DataFrame, na_tokens: bool = False) -> DataFrame:
    """Null becomes the empty text; with ``na_tokens`` so do the spellings of a missing CSV cell."""

    def filled(name: str):
        c = F.col(f"`{name}`")
        known = F.when(~c.isin(lx.NA_TOKENS), c) if na_tokens else c
        return F.coalesce(known, F.lit("")).alias(name)

    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[filled(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def _column_rank(columns: list[str]) -> list[str]:
    likely = [c for c in columns if any(w in c.lower() for w in lx.DESCRIPTIVE_WORDS)]
    return likely + [c for c in columns if c not in likely]


def detect_description_columns(df: DataFrame) -> list[str]:
    """Columns that carry product text, likely names first; columns blank in every row drop out.

    One aggregate over all columns; one row of flags comes back.
    """
    columns = [c for c in df.columns if c != "src_ord"]
    if TARGET in columns:
        return [TARGET]
    ranked = _column_rank(columns)
    flags = df.agg(*[
        F.max(has_text(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(ranked)
    ]).first()
    kept = [c for i, c in enumerate(ranked) if flags[i]]
    return kept or ranked


def resolve_columns(df: DataFrame, wanted: str) -> list[str]:
    """The existing ones of a comma-separated list, in the caller's order."""
    names = [c.strip() for c in wanted.split(",") if c.strip() in df.columns]
    if not names:
        raise ValueError(f"none of the requested columns exist; available: {df.columns}")
    return names


def build_description(df: DataFrame, columns: list[str], labeled: bool = True) -> DataFrame:
    """Merge columns into ``raw_description``: one ``Label: value`` line per non-blank value.

    Deviation: a selection of exactly ``raw_description`` is used as it is, without a label.
    """
    if columns == [TARGET]:
        return df.withColumn(TARGET, F.coalesce(F.col(TARGET), F.lit("")))

    def line(name: str):
        value = py_strip(F.col(f"`{name}`").cast("string"))
        label = f"{name.replace('_', ' ').title()}: " if labeled else ""
        return F.when(~F.lower(value).isin(lx.BLANK_WORDS), F.concat(F.lit(label), value))

    return df.withColumn(TARGET, F.concat_ws("\n", *[line(c) for c in columns]))


def drop_empty(df: DataFrame, column: str = TARGET) -> DataFrame:
    """Drop null and whitespace-only texts. Runs before cleaning: ``<br>`` survives as empty text."""
    return df.filter(has_text(F.col(column)))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the contract's columns, in its order; absent ones are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def to_raw(df: DataFrame) -> DataFrame:
    """``id`` and ``raw_description`` with their declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])


def filter_confidence(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows at or above the threshold."""
    return df.filter(F.col("confidence") >= F.lit(threshold))


def numeric_not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value reads as a number."""
    return df.filter(F.col(column).try_cast("double").isNotNull())
