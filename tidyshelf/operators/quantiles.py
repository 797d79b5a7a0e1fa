"""Exact quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyshelf.operators.ordering import running_start, sorted_slices
from tidyshelf.storage import Workspace


def value_counts_by(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, value, n)`` without nulls: repeated values collapse in each task."""
    return (
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    )


def counted_slices(
    df: DataFrame, value: str, by: Sequence[str] = (), workspace: Workspace | None = None
) -> DataFrame:
    """The counted distinct values as a written table of sorted slices."""
    return sorted_slices(value_counts_by(df, value, by), [*by, value], workspace)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    workspace: Workspace | None = None,
    slices: DataFrame | None = None,
) -> DataFrame:
    """``(by…, p, quantile)`` with linear interpolation between neighbours.

    Spark's ``percentile`` keeps all values of a group in one buffer. Here the distinct values are
    counted, range-partitioned with their group (a hot group spreads over slices), and only the
    slices that hold a wanted rank are looked into. ``slices`` saves the count if it exists
    (see :func:`counted_slices`).
    """
    by = list(by)
    if slices is None:
        slices = counted_slices(df, value, by, workspace)

    # one row per slice and group
    totals = slices.groupBy(*by, "_slice").agg(F.sum("n").alias("_m"))
    everything = Window.partitionBy(*by)
    spans = totals.select(
        *by, "_slice",
        running_start(F.col("_m"), "_slice", *by).alias("_start"), "_m",
        F.sum("_m").over(everything).alias("_total"),
    )
    wanted = (
        spans.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("_rank", F.col("p") * (F.col("_total") - 1))
        .withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_rank"), F.ceil("_rank")))))
        .filter((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_m")))
        .select(*by, "_slice", "_start", "p", "_rank", "_at")
    )
    inside = slices.join(wanted.select(*by, "_slice", "_start").distinct(), [*by, "_slice"])
    order = Window.partitionBy(*by, "_slice").orderBy(value)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.withColumn("_from", F.col("_start") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    hits = ranked.select(*by, "_slice", value, "_from", "n").join(wanted, [*by, "_slice"]).filter(
        (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("n"))
    )
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    share = F.first("_rank") - F.floor(F.first("_rank"))
    return hits.groupBy(*by, "p").agg((low + (high - low) * share).alias("quantile"))


def approximate_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """``(by…, p, quantile)`` from mergeable sketches, for a quick look at very large tables."""
    ps = [float(p) for p in probabilities]
    sketch = F.percentile_approx(value, ps, accuracy)
    pairs = F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("_q").alias("quantile"))
    return (
        df.groupBy(*by).agg(sketch.alias("_q")).select(*by, F.inline(pairs))
        .withColumn("quantile", F.col("quantile").cast("double"))
    )


def wide_quantiles(
    quantiles: DataFrame, names: dict[float, str], by: Sequence[str] = ()
) -> DataFrame:
    """One column per probability."""
    picked = [
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(name)
        for p, name in names.items()
    ]
    return quantiles.groupBy(*by).agg(*picked)
