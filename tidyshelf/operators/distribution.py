"""Histograms, descriptive statistics and box plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.operators.quantiles import (
    approximate_quantiles,
    counted_slices,
    exact_quantiles,
    value_counts_by,
    wide_quantiles,
)
from tidyshelf.operators.summary import top_k
from tidyshelf.storage import Workspace


def histogram(df: DataFrame, column: str, bins: int, weight: str | None = None) -> DataFrame:
    """``(bin, low, high, count)`` over [min, max] in equal widths, empty bins included.

    Bins are closed on the left, the last one on both sides. A value next to an edge goes by
    comparison with the edge itself, and a single value gets a range of one around it. With
    ``weight`` each row stands for so many.
    """
    x = F.col("_x")
    times = F.col(weight) if weight else F.lit(1).cast("long")
    values = df.select(F.col(column).try_cast("double").alias("_x"), times.alias("_n")).filter(x.isNotNull())
    bounds = values.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).select(F.struct("lo", "hi").alias("_b")).scalar()
    placed = values.withColumn("_b", bounds).select(
        "_x", "_n", F.col("_b.lo").alias("_lo"), ((F.col("_b.hi") - F.col("_b.lo")) / bins).alias("_w")
    ).withColumn("_i", F.least(F.lit(bins - 1), F.floor((x - F.col("_lo")) / F.col("_w"))).cast("int"))
    edge = lambda i: F.col("_lo") + i * F.col("_w")
    shift = F.when(x < edge(F.col("_i")), -1).when(
        (x >= edge(F.col("_i") + 1)) & (F.col("_i") < bins - 1), 1).otherwise(0)
    counts = placed.groupBy((F.col("_i") + shift).alias("bin")).agg(F.sum("_n").alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_b", bounds)
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    return (
        grid.filter(F.col("_b.lo").isNotNull())
        .join(F.broadcast(counts), "bin", "left")  # at most one row per bin
        .select(
            "bin",
            (F.col("_b.lo") + F.col("bin") * width).alias("low"),
            (F.col("_b.lo") + (F.col("bin") + 1) * width).alias("high"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def describe(
    df: DataFrame, column: str, approximate: bool = False, workspace: Workspace | None = None
) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max, to one decimal, one row."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    quantiles = (
        approximate_quantiles(df, column, list(names)) if approximate
        else exact_quantiles(df, column, list(names), workspace=workspace)
    )
    q = wide_quantiles(quantiles, names).select(F.struct(*names.values()).alias("_q")).scalar()
    c = F.col(column)
    stats = df.agg(
        F.count(c).alias("count"), F.round(F.avg(c), 1).alias("mean"),
        F.round(F.stddev_samp(c), 1).alias("std"), F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max"),
    ).withColumn("_q", q)
    return _described(stats, names)


def _described(stats: DataFrame, names: dict[float, str]) -> DataFrame:
    quartiles = [F.round(F.col(f"_q.{n}"), 1).alias(n) for n in names.values()]
    return stats.select("count", "mean", "std", "min", *quartiles, "max")


def describe_counts(counts: DataFrame, value: str, weight: str, quartiles: DataFrame) -> DataFrame:
    """:func:`describe` of a table of distinct values and their counts; ``quartiles`` is one row q1, median, q3."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    x, n = F.col(value).cast("double"), F.when(F.col(value).isNotNull(), F.col(weight))
    moments = counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"), F.sum(n * x).alias("_s"), F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    ).withColumn("_mean", F.when(F.col("count") > 0, F.col("_s") / F.col("count")))
    # deviations from the mean, not a difference of large sums
    apart = counts.select(n.alias("_n"), x.alias("_x")).withColumn("_m", moments.select("_mean").scalar()).agg(
        F.sum(F.col("_n") * F.pow(F.col("_x") - F.col("_m"), 2)))
    spread = F.when(F.col("count") > 1, F.sqrt(apart.scalar() / (F.col("count") - 1)))
    stats = moments.select("count", F.round("_mean", 1).alias("mean"), F.round(spread, 1).alias("std"), "min", "max").withColumn(
        "_q", quartiles.select(F.struct(*names.values())).scalar())
    return _described(stats, names)


def median(
    df: DataFrame, column: str, approximate: bool = False, workspace: Workspace | None = None
) -> DataFrame:
    """The exact median of a numeric column, one row."""
    if approximate:
        found = approximate_quantiles(df, column, [0.5])
    else:
        found = exact_quantiles(df, column, [0.5], workspace=workspace)
    return found.agg(F.max("quantile").alias("median"))


def _boxed(clean, group, value, k, approximate, workspace):
    """Counts per (group, value) of the k largest groups, with the group's quartiles and fences."""
    groups = top_k(clean, group, k).select(group)  # k rows
    kept = clean.join(F.broadcast(groups), group, "left_semi")
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    if approximate:
        counts = value_counts_by(kept, value, [group])
        quantiles = approximate_quantiles(
            kept.filter(F.col(value).isNotNull()), value, list(names), [group]
        )
    else:  # the counted values are written once and serve the quartiles and the box
        slices = counted_slices(kept, value, [group], workspace)
        counts = slices.select(group, value, "n")
        quantiles = exact_quantiles(kept, value, list(names), [group], slices=slices)
    return fenced(counts, wide_quantiles(quantiles, names, [group]), group)  # k rows


def fenced(counts: DataFrame, boxes: DataFrame, group: str) -> DataFrame:
    """Counted values next to the quartiles and fences of their group; ``boxes`` has one row per group."""
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return counts.join(F.broadcast(boxes), group).withColumns(
        {"_low": F.col("q1") - reach, "_high": F.col("q3") + reach}
    )


def box_stats(
    clean: DataFrame, group: str = "category", value: str = "price", k: int = 8,
    approximate: bool = False, workspace: Workspace | None = None,
) -> DataFrame:
    """Box-plot numbers for the k largest groups.

    Whiskers end at the outermost data points within 1.5 interquartile ranges, but never inside the
    box; points beyond are outliers.
    """
    return box_numbers(_boxed(clean, group, value, k, approximate, workspace), group, value)


def box_numbers(boxed: DataFrame, group: str, value: str) -> DataFrame:
    """The box-plot numbers of :func:`fenced` counts (column ``n``)."""
    v = F.col(value)
    within = v.between(F.col("_low"), F.col("_high"))
    low = F.min(F.when(v >= F.col("_low"), v)).cast("double")
    high = F.max(F.when(v <= F.col("_high"), v)).cast("double")
    return boxed.groupBy(group).agg(
        F.sum("n").alias("count"),
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.least(low, F.max("q1")).alias("whisker_low"),
        F.greatest(high, F.max("q3")).alias("whisker_high"),
        F.sum(F.when(within, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
    )


def box_outliers(
    clean: DataFrame, group: str = "category", value: str = "price", k: int = 8,
    approximate: bool = False, workspace: Workspace | None = None,
) -> DataFrame:
    """The outlying values of :func:`box_stats` with their counts."""
    v = F.col(value)
    boxed = _boxed(clean, group, value, k, approximate, workspace)
    return boxed.filter(~v.between(F.col("_low"), F.col("_high"))).select(group, value, "n")
