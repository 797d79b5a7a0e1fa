"""Canonical values through alias dimensions."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import lexicon as lx
from tidyshelf.functions.text import py_lower_key, py_strip, py_title, sanitize_text
from tidyshelf.storage import Workspace

Dimension = Mapping[str, str] | DataFrame


def alias_table(df: DataFrame, dim: Dimension) -> DataFrame:
    """``(ord, alias, canonical)`` with one row per alias, the first in order.

    A mapping is a local table. Whether a table is broadcast is up to Spark, which knows its size.
    """
    if isinstance(dim, DataFrame):
        first = F.min(F.struct("ord", "canonical"))
        return dim.groupBy("alias").agg(first.alias("_f")).select("_f.ord", "alias", "_f.canonical")
    rows = pa.table({
        "ord": pa.array(range(len(dim)), pa.int32()),
        "alias": pa.array(dim.keys(), pa.string()),
        "canonical": pa.array(dim.values(), pa.string()),
    })
    return df.sparkSession.createDataFrame(rows)


def _look_up(df: DataFrame, column: str, dim: Dimension) -> DataFrame:
    """Add ``_key`` and ``_hit``, the exact match of the lower-cased, stripped text."""
    table = alias_table(df, dim).select(F.col("alias").alias("_key"), F.col("canonical").alias("_hit"))
    return df.withColumn("_key", py_lower_key(F.col(column))).join(table, "_key", "left")


def normalize_brand(df: DataFrame, dim: Dimension = lx.BRAND_ALIASES) -> DataFrame:
    """Alias match, else the stripped text in title case."""
    found = _look_up(df, "brand", dim)
    value = F.coalesce("_hit", py_title(py_strip(F.col("brand"))))
    return found.withColumn("brand", value).select(*df.columns)


def _resolve_keys(keys: DataFrame, table: DataFrame, sizes: Column) -> DataFrame:
    """``(_key, _hit)``: the alias equal to the key, else the first in order that the key contains.

    Keys are cut into substrings as long as some alias, which meet the aliases in an equi-join.
    """
    size = F.char_length("_key")
    keys = keys.withColumn("_sizes", sizes)
    cuts = F.flatten(F.transform("_sizes", lambda n: F.transform(
        F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(F.col("_key"), i, n))))
    parts = keys.select("_key", F.explode(F.array_distinct(cuts)).alias("alias"))
    matched = parts.join(table.select("alias", "ord"), "alias").groupBy("_key").agg(
        F.coalesce(F.min(F.when(F.col("alias") == F.col("_key"), F.col("ord"))), F.min("ord")).alias("ord"))
    return matched.join(table.select("ord", F.col("canonical").alias("_hit")), "ord").select("_key", "_hit")


def normalize_category(
    df: DataFrame, dim: Dimension = lx.CATEGORY_ALIASES, workspace: Workspace | None = None
) -> DataFrame:
    """Alias match, else the first alias in dimension order contained in the text, else title case.

    One plan at every size: distinct keys are resolved first and one join brings them back. With a
    workspace the resolved keys are written before that join, so that a frequent text can be split.
    """
    table = alias_table(df, dim)
    lengths = F.array_sort(F.collect_set(F.char_length("alias")))
    sizes = table.agg(lengths).scalar() if isinstance(dim, DataFrame) else F.array(
        *[F.lit(n) for n in sorted({len(a) for a in dim})]).cast("array<int>")
    keyed = df.withColumn("_key", py_lower_key(F.col("category")))
    resolved = _resolve_keys(keyed.filter(F.col("_key").isNotNull()).select("_key").distinct(), table, sizes)
    if workspace:
        resolved = workspace.freeze(resolved, "categories")
    value = F.coalesce(F.col("_hit"), py_title(py_strip(F.col("category"))))
    return keyed.join(resolved, "_key", "left").withColumn("category", value).select(*df.columns)


def normalize_availability(df: DataFrame, dim: Dimension = lx.AVAILABILITY_ALIASES) -> DataFrame:
    """Alias match, else ``only N left`` at the start is limited stock, else the stripped text."""
    found = _look_up(df, "availability", dim)
    limited = F.when(F.col("_key").rlike(r"^only \p{Nd}+ left"), F.lit("Limited Stock"))
    value = F.coalesce(F.col("_hit"), limited, py_strip(F.col("availability")))
    return found.withColumn("availability", value).select(*df.columns)


def normalize_offer(c: Column) -> Column:
    """Collapse whitespace; a blank offer is none."""
    return F.nullif(sanitize_text(c), F.lit(""))


def normalize_seller(c: Column) -> Column:
    """Strip and title-case; the empty text is none, but blanks become the empty text."""
    return F.when(c != "", py_title(py_strip(c)))


def normalize_currency_case(c: Column) -> Column:
    return F.when(c != "", F.upper(c)).otherwise(F.lit(lx.DEFAULT_CURRENCY))


def postprocess(
    clean: DataFrame,
    brands: Dimension = lx.BRAND_ALIASES,
    categories: Dimension = lx.CATEGORY_ALIASES,
    availability: Dimension = lx.AVAILABILITY_ALIASES,
    workspace: Workspace | None = None,
) -> DataFrame:
    """All canonical forms; name, price, delivery and confidence stay as they are."""
    named = normalize_brand(clean, brands)
    placed = normalize_category(named, categories, workspace)
    stocked = normalize_availability(placed, availability)
    return stocked.withColumns({
        "offer": normalize_offer(F.col("offer")),
        "seller": normalize_seller(F.col("seller")),
        "currency": normalize_currency_case(F.col("currency")),
    })
