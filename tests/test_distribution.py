"""Histograms, quantiles and boxes against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyshelf.operators import distribution as di
from tidyshelf.operators import quantiles as qu
from tidyshelf.operators import summary as su

rng = np.random.default_rng(7)
GROUPS = {
    "hot": np.round(rng.lognormal(3, 2, 6000), 2), "ties": np.repeat([5.0, 5.0, 7.0], 500),
    "one": np.array([3.5]), "two": np.array([1.0, 2.0]),
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(g, float(x)) for g, xs in GROUPS.items() for x in xs] + [("hot", None), ("void", None)]
    return spark.createDataFrame(rows, "g STRING, x DOUBLE").repartition(8)


def test_quantiles(values):
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"], r["p"]): r["quantile"] for r in qu.exact_quantiles(values, "x", ps, ["g"]).collect()}
    assert set(got) == {(g, p) for g in GROUPS for p in ps}
    for g, xs in GROUPS.items():
        for p in ps:
            assert got[g, p] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    everything = np.concatenate(list(GROUPS.values()))
    assert di.median(values, "x").first()[0] == pytest.approx(np.median(everything))
    near = di.median(values, "x", approximate=True).first()[0]
    assert near == pytest.approx(np.median(everything), rel=0.01)


def test_empty_quantiles(spark):
    empty = spark.createDataFrame([(None,)], "x DOUBLE")
    assert di.median(empty, "x").first()[0] is None
    row = di.describe(empty, "x").first()
    assert row["count"] == 0 and row["median"] is None


@pytest.mark.parametrize("bins", [1, 7, 20, 30])
def test_histogram(spark, bins):
    xs = np.concatenate([np.round(rng.uniform(0, 1, 3000), 2), np.linspace(0, 1, bins + 1)])
    df = spark.createDataFrame([(float(x),) for x in xs], "x DOUBLE")
    rows = di.histogram(df, "x", bins).orderBy("bin").collect()
    counts, edges = np.histogram(xs, bins)
    assert [r["low"] for r in rows] == pytest.approx(list(edges[:-1])) and [r["high"] for r in rows] == pytest.approx(list(edges[1:]))
    assert sum(r["count"] for r in rows) == len(xs)
    got = np.array([r["count"] for r in rows])
    inner = ~np.isin(xs, edges)
    assert abs(got - counts).sum() <= 2 * (~inner).sum()
    for x in (0.0, 1.0):
        assert got[0 if x == 0 else -1] >= (xs == x).sum()


def test_histogram_of_one_value(spark):
    rows = di.histogram(spark.createDataFrame([(4.0,), (4.0,), (None,)], "x DOUBLE"), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == list(np.histogram([4.0, 4.0], 4)[0]) and rows[0]["low"] == 3.5
    assert di.histogram(spark.createDataFrame([], "x DOUBLE"), "x", 4).count() == 0


def test_boxes(values):
    rows = {r["g"]: r for r in di.box_stats(values, "g", "x", 3).collect()}
    assert set(rows) == {"hot", "ties", "two"}
    for g, r in rows.items():
        xs = GROUPS[g]
        q1, med, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3))
        assert r["whisker_low"] == pytest.approx(min(xs[xs >= lo].min(), q1)) and r["whisker_high"] == pytest.approx(max(xs[xs <= hi].max(), q3))
        assert r["outliers"] == ((xs < lo) | (xs > hi)).sum() and r["count"] == len(xs)
    out = di.box_outliers(values, "g", "x", 3).groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {r["g"]: r["n"] for r in out} == {g: r["outliers"] for g, r in rows.items() if r["outliers"]}


def test_describe(spark):
    xs = rng.integers(10, 500, 1001)
    df = spark.createDataFrame([(int(x),) for x in xs], "x INT")
    r = di.describe(df, "x").first()
    want = [len(xs), xs.mean(), xs.std(ddof=1), xs.min(), *np.quantile(xs, [0.25, 0.5, 0.75]), xs.max()]
    assert list(r) == pytest.approx([round(float(w), 1) for w in want])


def test_summary_of_nothing(spark):
    tagged = spark.createDataFrame([], "error_type STRING, confidence DOUBLE")
    assert tuple(su.run_summary(tagged).first()) == (0, 0, 0, 0.0)
    assert su.average_confidence(tagged).first()[0] == 0.0
    assert tuple(su.below_threshold(tagged).first()) == (0.0, 0.5, 0, 0.0)
    assert [tuple(r) for r in su.success_failure(tagged).collect()] == [("Success", 0, 0.0), ("Failed", 0, 0.0)]


def test_top_k_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaad"] + [(None,)], "v STRING")
    assert [tuple(r) for r in su.top_k(df, "v", 2).collect()] == [("a", 2), ("b", 2)]
