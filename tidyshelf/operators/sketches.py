"""Quantiles and distinct counts of a growing table, from states stored per batch.

A state is a row with a sketch. Each batch of input is summarized once; what was added before is never read again,
and the states of all batches merge into those of the whole table. Exact counterparts: ``exact_quantiles``,
``describe``, ``duplicate_report``.

* KLL sketches keep about ``k`` values of a numeric column, whatever its length. The rank of an answer is off by
  ``rank_error(k)`` of all rows at most in 99 of 100 answers, for merged sketches too.
* Theta sketches keep up to ``2**lg`` hashes of the values. Up to so many distinct values a count is exact, beyond it has a
  relative standard error of ``distinct_error(lg)``. They can be subtracted: what a batch brings that no
  earlier one had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values a quantile sketch keeps, about, and the power of two of hashes in a distinct sketch.
KLL_K, THETA_LG = 800, 14


def rank_error(k: int = KLL_K) -> float:
    """How far the rank of a quantile is off at most, as a share of the rows, with 99 % confidence."""
    return 2.296 / k**0.9723


def distinct_error(lg: int = THETA_LG) -> float:
    """The relative standard error of a distinct count beyond ``2**lg``."""
    return 2 ** (-lg / 2)


def quantile_states(df: DataFrame, value: str, by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """``(by…, total, missing, low, high, sketch)``: one row per group, no row for an empty table with groups.

    ``low`` and ``high`` are exact. Nulls and NaN count as missing. Without any value the sketch is null.
    """
    x = F.col(value).cast("double")
    known = F.when(x.isNotNull() & ~F.isnan(x), x)
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(known.isNull()).alias("missing"), F.min(known).alias("low"), F.max(known).alias("high"),
        F.when(F.count(known) > 0, F.kll_sketch_agg_double(known, k)).alias("sketch"))


def merged_quantiles(states: DataFrame, by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """The states of each group, over all batches, as one."""
    some = F.count("sketch") > 0
    return states.groupBy(*by).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.when(some, F.kll_merge_agg_double("sketch", k)).alias("sketch"))


def quantiles_of(states: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by…, p, quantile)`` of merged states; 0 and 1 give the exact ends, groups without a value nothing."""
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    found = states.filter("sketch IS NOT NULL").select(*by, "low", "high", F.arrays_zip(
        ps.alias("p"), F.kll_sketch_get_quantile_double("sketch", ps).alias("q")).alias("_all"))
    p = F.col("_each.p")
    return found.withColumn("_each", F.explode("_all")).select(
        *by, p.alias("p"), F.when(p == 0, F.col("low")).when(p == 1, F.col("high")).otherwise(F.col("_each.q")).alias("quantile"))


def rank_of(states: DataFrame, x: float, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, share)``: which share of the values is at most ``x``."""
    share = F.kll_sketch_get_rank_double("sketch", F.lit(float(x)))
    return states.filter("sketch IS NOT NULL").select(*by, share.alias("share"))


def distinct_states(df: DataFrame, column: str, by: Sequence[str] = (), lg: int = THETA_LG) -> DataFrame:
    """``(by…, total, missing, sketch)`` of the texts of a column; nulls count as missing."""
    text = F.col(column).cast("string")
    # a sketch leaves out empty strings; the mark keeps them apart from nulls
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(text.isNull()).alias("missing"),
        F.theta_sketch_agg(F.concat(F.lit("="), text), lg).alias("sketch"))


def merged_distinct(states: DataFrame, by: Sequence[str] = (), lg: int = THETA_LG) -> DataFrame:
    """The states of each group, over all batches, as one."""
    return states.groupBy(*by).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        F.theta_union_agg("sketch", lg).alias("sketch"))


def duplicates_of(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, total, missing, distinct, duplicates)`` of merged states, as ``duplicate_report`` counts them.

    A repeated missing text is a duplicate of the first one.
    """
    distinct = F.theta_sketch_estimate("sketch")
    once = distinct + F.least("missing", F.lit(1))
    return states.select(*by, "total", "missing", distinct.alias("distinct"), F.greatest(F.col("total") - once, F.lit(0)).alias("duplicates"))


def unseen_of(batch: DataFrame, before: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, distinct, unseen)``: distinct texts of a batch's merged states, and those that no earlier batch had."""
    old = before.select(*by, F.col("sketch").alias("_old"))
    joined = batch.join(old, list(by), "left") if by else batch.withColumn("_old", old.select("_old").scalar())
    unseen = F.when(F.col("_old").isNull(), F.theta_sketch_estimate("sketch")).otherwise(
        F.theta_sketch_estimate(F.theta_difference("sketch", "_old")))
    return joined.select(*by, F.theta_sketch_estimate("sketch").alias("distinct"), unseen.alias("unseen"))


def store_batch(states: DataFrame, path: str, batch: str) -> None:
    """Write a batch's states to the table of states. A batch that is stored again replaces what it had."""
    states.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """All batches' states; ``batch`` is the text it was stored under."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "batch" else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(path)
