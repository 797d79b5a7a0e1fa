"""States per batch against the exact operators over all rows."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from checks.views import table
from conftest import SF
from tidyshelf.operators import sketches as sk
from tidyshelf.operators.dedup import duplicate_report
from tidyshelf.operators.distribution import describe


def grown(states, path, df, batches, **options):
    """Store the states of each batch on its own; a table that was stored is not read again."""
    for i in range(batches):
        sk.store_batch(states(df.filter(F.col("part") == i), **options), path, f"{i:02d}")
    return sk.stored_states(df.sparkSession, path)


def test_quantiles_of_a_growing_table(spark, tmp_path):
    rng = random.Random(1)
    values = [round(rng.lognormvariate(3, 2), 3) for _ in range(60_000)]
    df = spark.createDataFrame([(i * 7 // len(values), "ab"[i % 2], v) for i, v in enumerate(values)], "part int, kind string, x double")
    stored = grown(sk.quantile_states, str(tmp_path / "s"), df, 7, value="x", by=["kind"])
    assert stored.count() == 14
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    merged = sk.merged_quantiles(stored, ["kind"])
    assert sorted((r.kind, r.total, r.missing) for r in merged.collect()) == [("a", 30_000, 0), ("b", 30_000, 0)]
    for r in sk.quantiles_of(merged, ps, ["kind"]).collect():
        own = sorted(values["ab".index(r.kind) :: 2])
        low, high = bisect_left(own, r.quantile) / len(own), bisect_right(own, r.quantile) / len(own)
        assert low - 2 * sk.rank_error() <= r.p <= high + 2 * sk.rank_error()
        assert r.p not in (0, 1) or r.quantile == own[0 if r.p == 0 else -1]
    whole = sk.merged_quantiles(stored)
    share = sk.rank_of(whole, 20.0).first()["share"]
    assert share == pytest.approx(sum(v <= 20 for v in values) / len(values), abs=2 * sk.rank_error())
    assert sk.rank_error(200) < 0.0135 < 4 * sk.rank_error(800)


def test_states_of_a_few_values_are_exact(spark):
    """Up to k values a sketch holds them all; nulls and NaN are missing, and nothing at all is no quantile."""
    lines = table(spark, SF, "lineitem").limit(500)
    merged = sk.merged_quantiles(sk.quantile_states(lines, "l_quantity"))
    exact = describe(lines, "l_quantity").first()
    row = merged.first()
    assert (row.total, row.low, row.high) == (500, exact["min"], exact["max"])
    odd = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    row = sk.merged_quantiles(sk.quantile_states(odd, "x").unionByName(sk.quantile_states(odd.limit(0), "x"))).first()
    assert (row.total, row.missing, row.low, row.high) == (4, 2, 1.0, 3.0)
    nothing = sk.merged_quantiles(sk.quantile_states(odd.filter("x IS NULL"), "x"))
    assert nothing.first()["missing"] == 1 and sk.quantiles_of(nothing, [0.5]).count() == 0
    assert sk.quantile_states(odd.limit(0), "x", ["x"]).count() == 0


def test_duplicates_of_a_growing_table(spark, tmp_path):
    """Below 2**lg distinct texts all counts are exact, with nulls and empty texts; a repeated batch counts once."""
    texts = [None, "", "a", "A"] + [f"t{i}" for i in range(900)]
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 5, rng.choice(texts)) for i in range(4000)], "part int, t string")
    path = str(tmp_path / "s")
    grown(sk.distinct_states, path, df, 5, column="t")
    stored = grown(sk.distinct_states, path, df, 2, column="t")
    assert stored.count() == 5
    got, exact = sk.duplicates_of(sk.merged_distinct(stored)).first(), duplicate_report(df, "t").first()
    assert (got.total, got.missing, got.duplicates) == (exact.total, exact.missing, exact.duplicates)
    old, new = sk.merged_distinct(stored.filter("batch < '04'")), sk.merged_distinct(stored.filter("batch = '04'"))
    before = {r.t for r in df.filter("part < 4 AND t IS NOT NULL").collect()}
    last = {r.t for r in df.filter("part = 4 AND t IS NOT NULL").collect()}
    assert tuple(sk.unseen_of(new, old).first()) == (len(last), len(last - before))
    assert tuple(sk.unseen_of(new, sk.merged_distinct(stored.limit(0))).first())[1] == len(last)


def test_many_texts_are_estimated(spark):
    df = spark.range(300_000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("text "), F.floor(F.col("id") / 2)).alias("t"))
    states = sk.distinct_states(df, "t", ["g"], lg=12).unionByName(sk.distinct_states(df.filter("id < 1000"), "t", ["g"], lg=12))
    for r in sk.duplicates_of(sk.merged_distinct(states, ["g"], lg=12), ["g"]).collect():
        own = len({i // 2 for i in range(300_000) if i % 3 == r.g})
        assert abs(r.distinct - own) < 4 * sk.distinct_error(12) * own
        assert r.total > 100_000
