"""Exact duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.operators.ordering import as_columns

_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}


def dedup_exact(df: DataFrame, key: str, order: str | Sequence[str]) -> DataFrame:
    """Keep the first row per text; the columns stay as they are.

    A plain aggregation: copies of a hot text collapse in each task before the shuffle. If the key
    and one number are all there is, the buffers have a fixed size and it stays a hash aggregation.
    Otherwise the rows are grouped by a hash ahead of the text, so that sorting seldom compares
    texts; the text itself still decides.
    """
    names = as_columns(order)
    types = dict(df.dtypes)
    if set(df.columns) == {key, *names} and len(names) == 1 and types[names[0]] in _NUMBERS:
        return df.groupBy(key).agg(F.min(names[0]).alias(names[0])).select(*df.columns)
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*names) if len(names) > 1 else F.col(names[0]))
    grouped = (
        df.withColumn("_hash", F.xxhash64(key)).groupBy("_hash", key).agg(first.alias("_first"))
    )
    return grouped.select(key, "_first.*").select(*df.columns)


def duplicate_report(df: DataFrame, column: str) -> DataFrame:
    """Rows, missing texts and repeated texts. Texts are counted by their SHA-256 digest."""
    digest = F.sha2(F.col(column), 256)
    null = F.max(F.col(column).isNull().cast("int"))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(column).isNull()).alias("missing"),
        (F.count("*") - F.count_distinct(digest) - F.coalesce(null, F.lit(0))).alias("duplicates"),
    )
