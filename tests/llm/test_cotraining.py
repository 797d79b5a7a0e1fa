import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm import cotraining as co
from tidyshelf.llm.common import Hashes, table
from tidyshelf.llm.cotraining import metadata_view, score_quality, text_view

SF = "/root/testdata/sf0.01"


def plain_fit(sets, b, steps):
    """Newton steps over (x, y, weight of the set) at once, written row by row."""
    for _ in range(steps):
        gradient, hessian = -0.01 * b, 0.01 * np.eye(len(b))
        for x, y, weight in sets:
            for row, label in zip(x, y, strict=True):
                p = 1 / (1 + np.exp(-max(-30, min(30, row @ b))))
                gradient = gradient + weight * (label - p) * row
                hessian = hessian + weight * p * (1 - p) * np.outer(row, row)
        step = np.linalg.solve(hessian, gradient)
        b = b + step * min(1, 5 / np.abs(step).max())
    return b


def plain_scores(docs, labels, apart):
    """All of it over lists, without Spark: labels by id, the ids kept for the calibration, rows (id, text, n_chars, lang, source)."""
    hashes = Hashes()
    one = lambda v: np.concatenate(([1.0], v.astype(np.float32)))
    views = [np.array([one(text_view((d[1] or "").encode(), hashes)) for d in docs]), np.array([one(metadata_view(*d[2:])) for d in docs])]
    held = np.array([zlib.crc32(str(d[0]).encode()) % 5 == 0 for d in docs])
    listed = np.array([d[0] in labels for d in docs])
    y = np.array([float(labels.get(d[0]) or 0) for d in docs])
    kept = np.array([d[0] in apart for d in docs])
    fit, calibrate, pool = listed & ~held & ~kept, listed & ~held & kept, ~listed
    weights = [plain_fit([(x[fit], y[fit], 1)], np.zeros(x.shape[1]), 6) for x in views]

    def calibrated(x, w):
        z = np.clip(x @ w, -30, 30)
        lines = np.column_stack((np.ones(len(z)), z))
        shift, slope = plain_fit([(lines[calibrate], y[calibrate], 1)], np.zeros(2), 5)
        return shift + slope * z

    for _ in range(3):
        odds = [np.clip(calibrated(x, w), -30, 30) for x, w in zip(views, weights, strict=True)]
        after = []
        for i, x in enumerate(views):
            p = 1 / (1 + np.exp(-odds[1 - i]))
            sure = pool & ((p >= 0.97) | (p <= 0.03))
            told = (x[sure], (p[sure] >= 0.5).astype(float), min(1, fit.sum() / max(1, sure.sum())))
            after.append(plain_fit([(x[fit], y[fit], 1), told], weights[i], 2))
        weights = after
    total = sum(calibrated(x, w) for x, w in zip(views, weights, strict=True))
    return {d[0]: 1 / (1 + np.exp(-max(-30, min(30, t)))) for d, t in zip(docs, total, strict=True)}


def test_scores_equal_a_plain_run(spark):
    docs = table(spark, SF, "documents").filter("doc_id % 3 = 0")
    labels = table(spark, SF, "labels")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "n_chars", "lang", "source").collect()]
    apart = {r[0] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).select("doc_id").collect()}
    want = plain_scores(rows, {r["doc_id"]: r["quality"] for r in labels.collect()}, apart)
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, labels).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert rows and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.93


def test_unlabelled_rows_teach(spark):
    """Pseudo-labels of all unlabelled rows change the fit; many more of them do not outweigh the labels."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = lambda df, **o: {r["doc_id"]: r["score"] for r in score_quality(df, labels, **o).collect()}
    alone, taught = scores(docs, rounds=0), scores(docs)
    assert max(abs(alone[i] - taught[i]) for i in alone) > 1e-3
    copies = docs.join(labels, "doc_id", "left_anti").crossJoin(spark.range(1, 9)).withColumn("doc_id", F.col("doc_id") + F.col("id") * 10**9).drop("id")
    more = scores(docs.unionByName(copies))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((more[i] >= 0.5) == truth[i] for i in held) / len(held) >= 0.93


def test_odd_texts(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    meta = ["'en' AS lang", "CAST(NULL AS string) AS source", "CAST(NULL AS long) AS n_chars"]
    assert score_quality(odd.selectExpr("*", *meta), labels).count() == len(ODD_TEXTS)
    assert score_quality(empty.selectExpr("*", *meta), labels).count() == 0
    many = spark.createDataFrame([(i // 3, i % 2) for i in range(12)], "doc_id long, quality int")
    rows = score_quality(odd.selectExpr("*", *meta), many).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert co.text_view(b"", Hashes()).shape == (10 + 64,)
