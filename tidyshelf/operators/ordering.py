"""Total order on many partitions: sorted slices, positional ids, heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyshelf.storage import Workspace, workspace_for

_ROW_BITS = 33


def as_columns(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def sorted_slices(
    df: DataFrame, order: str | Sequence[str], workspace: Workspace | None = None
) -> DataFrame:
    """Range-partition and sort, and keep each row's slice (``_slice``) and place in it (``_row``).

    The slices follow the order, and a hot leading value is split by the columns after it. The
    result is a written table: the numbers are data and stay the same if executors are lost.
    """
    names = as_columns(order)
    place = F.monotonically_increasing_id()
    numbered = (
        df.repartitionByRange(*names)
        .sortWithinPartitions(*names)
        .withColumn("_place", place)
    )
    frozen = workspace_for(df, workspace).freeze(numbered, "slices")
    return frozen.withColumns({
        "_slice": F.shiftright("_place", _ROW_BITS),
        "_row": F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    }).drop("_place")


def running_start(total: Column, order: str, *by: str) -> Column:
    """Sum of ``total`` over the earlier rows. Used on one row per slice, never on the data."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(window), F.lit(0))


def assign_ids(
    df: DataFrame, order: str | Sequence[str], workspace: Workspace | None = None
) -> DataFrame:
    """``id`` = 1..n in input order, replacing an ``id`` column that is already there.

    The order must be unique. No window runs over the data: an offset per slice is enough.
    """
    source = df.drop("id") if "id" not in as_columns(order) else df.withColumnRenamed("id", "_id_in")
    names = ["_id_in" if n == "id" else n for n in as_columns(order)]
    slices = sorted_slices(source, names, workspace)
    starts = (
        slices.groupBy("_slice").agg(F.count("*").alias("_n"))
        .select("_slice", running_start(F.col("_n"), "_slice").alias("_start"))
    )
    # one row per slice: its size is the number of shuffle partitions
    numbered = slices.join(F.broadcast(starts), "_slice")
    kept = [c for c in source.columns if c != "_id_in"]
    return numbered.select((F.col("_start") + F.col("_row") + 1).alias("id"), *kept)


def head(df: DataFrame, n: int | None, order: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows in order; ``None`` or 0 keeps all."""
    return df.orderBy(*as_columns(order)).limit(n) if n else df


def preview(df: DataFrame, n: int, order: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows, as shown before a run."""
    return df.orderBy(*as_columns(order)).limit(n)
