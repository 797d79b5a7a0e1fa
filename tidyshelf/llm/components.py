"""Connected components by alternating star steps; every step is a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidyshelf.storage import Workspace


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(arcs: DataFrame) -> DataFrame:
    """Arcs a -> b with the smallest of a and all its b."""
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return arcs.join(least, "a")


def connected(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = workspace.freeze(now, "edges"), None
    while True:
        large = _star(_both_ways(now)).filter("b > a AND b <> m")
        downward = large.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))  # repeated arcs go with the next step's
        small = _star(downward)
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        # the arcs' number and the sum of their hashes are taken while they are written
        seen = Observation("arcs")
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = workspace.freeze(after.filter("a <> b").distinct().observe(seen, F.count("*").alias("n"), total.alias("s")), "star")
        state = seen.get
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return workspace.freeze(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
