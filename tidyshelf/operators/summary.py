"""Counts and rates of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_where(condition: Column | None = None, weight: str | None = None) -> Column:
    """How many rows meet a condition; with ``weight`` each row of the input stands for that many."""
    if weight is None:
        return F.count("*") if condition is None else F.count_if(condition)
    return F.coalesce(F.sum(weight if condition is None else F.when(condition, F.col(weight))), F.lit(0))


def run_summary(tagged: DataFrame, weight: str | None = None) -> DataFrame:
    """``total, success, errors, success_rate`` in one aggregation; the rate of nothing is 0."""
    good = rows_where(F.col("error_type").isNull(), weight)
    bad = rows_where(F.col("error_type").isNotNull(), weight)
    total = rows_where(weight=weight)
    rate = F.when(total > 0, F.round(good * 100.0 / total, 2)).otherwise(F.lit(0.0))
    return tagged.agg(
        total.alias("total"), good.alias("success"), bad.alias("errors"), rate.alias("success_rate")
    )


def _mean(column: str, weight: str | None) -> Column:
    c = F.col(column)
    if weight is None:
        return F.coalesce(F.avg(c), F.lit(0.0))
    known = rows_where(c.isNotNull(), weight)
    return F.when(known > 0, F.sum(c * F.col(weight)) / known).otherwise(F.lit(0.0))


def average_confidence(clean: DataFrame, weight: str | None = None) -> DataFrame:
    return clean.agg(_mean("confidence", weight).alias("avg_confidence"))


def below_threshold(df: DataFrame, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """Mean confidence next to the threshold, and the share of rows under it."""
    low, total = rows_where(F.col("confidence") < F.lit(threshold), weight), rows_where(weight=weight)
    return df.agg(
        _mean("confidence", weight).alias("mean_confidence"),
        F.lit(threshold).alias("threshold"),
        low.alias("below"),
        F.when(total > 0, low / total).otherwise(F.lit(0.0)).alias("below_share"),
    )


def value_counts(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(rows_where(weight=weight).alias("count")).orderBy(F.desc("count"), column)


def value_shares(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Rows and percentage per value. The input is counted once: the total sums the counts."""
    values = df.groupBy(F.col(column).alias("_value")).agg(rows_where(weight=weight).alias("count"))
    total = values.agg(F.sum("count")).scalar()  # reads the same exchange again
    return values.withColumn("percent", F.round(F.col("count") * 100.0 / total, 1)).select(
        F.col("_value").alias(column), "count", "percent").orderBy(F.desc("count"), column)


def top_k(df: DataFrame, column: str, k: int, weight: str | None = None) -> DataFrame:
    """The k most frequent values; equal counts in value order."""
    return value_counts(df.filter(F.col(column).isNotNull()), column, weight).limit(k)


def success_failure(tagged: DataFrame, weight: str | None = None) -> DataFrame:
    """Two rows: how many succeeded and failed, and their share in percent."""
    s = run_summary(tagged, weight)
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) * 100.0 / F.col("total"), 1)).otherwise(F.lit(0.0))
    row = lambda label, c: F.struct(F.lit(label).alias("outcome"), F.col(c).alias("count"), share(c).alias("percent"))
    return s.select(F.inline(F.array(row("Success", "success"), row("Failed", "errors"))))


def stage_counts(raw: DataFrame, preprocessed: DataFrame, tagged: DataFrame) -> DataFrame:
    """Rows at each stage: raw, after preprocessing, clean, errors."""

    def counted(df: DataFrame, position: int, stage: str) -> DataFrame:
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(position).alias("position"), F.lit(stage).alias("stage"), "rows"
        )

    outcome = run_summary(tagged).select(F.inline(F.array(
        F.struct(F.lit(3).alias("position"), F.lit("clean").alias("stage"), F.col("success").alias("rows")),
        F.struct(F.lit(4).alias("position"), F.lit("errors").alias("stage"), F.col("errors").alias("rows")),
    )))
    return counted(raw, 1, "raw").unionByName(counted(preprocessed, 2, "preprocessed")).unionByName(outcome)
