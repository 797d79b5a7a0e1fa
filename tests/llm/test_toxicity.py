import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm.common import table
from tidyshelf.llm.toxicity import END, INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT, Grammar, fit, keep_clean, score_toxicity

SF = "/root/testdata/sf0.01"


def test_grammar_kinds():
    """plain, with target, negated, reported; threats follow."""
    read = lambda *symbols: [i for i, w in enumerate(Grammar().read(list(symbols), [1.0] * len(symbols))) if w]
    assert read(OTHER, INSULT) == [0] and read(TARGET, OTHER, INSULT) == [1] and read(INSULT, TARGET) == [0]
    assert read(NEGATION, OTHER, INSULT) == [2] and read(NEGATION, OTHER, OTHER, OTHER, OTHER, INSULT) == [0]
    assert read(REPORT, OTHER, INSULT) == [3] and read(REPORT, END, INSULT) == [0] and read(NEGATION, END, INSULT) == [0]
    assert read(TARGET, THREAT) == [5] and read(THREAT) == [4]
    assert Grammar().read([INSULT, INSULT], [1.5, 2.0])[0] == 3.5


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = score_toxicity(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert scored.count() == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    out = [r for r in rows if r["held_out"]]
    hits = sum(r["predicted"] == r["toxic"] for r in out) / len(out)
    wrong = sum(r["predicted"] > r["toxic"] for r in out)
    assert hits >= 0.93 and wrong <= 2


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert vars(fit(docs, labels)) == vars(fit(docs, flipped))


def test_odd_texts_and_missing_labels(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for marked in (labels, labels.limit(0)):
        rows = score_toxicity(odd, marked).collect()
        assert len(rows) == len(ODD_TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert score_toxicity(empty, marked).count() == 0
        kept = keep_clean(odd, marked)
        assert kept.columns == odd.columns
    bad = spark.createDataFrame([(1, "you are a pathetic idiot and a moron"), (2, "a quiet day")], "doc_id long, text string")
    assert [r["predicted"] for r in score_toxicity(bad, labels.limit(0)).orderBy("doc_id").collect()] == [1, 0]


@pytest.mark.parametrize("limit", [5])
def test_sample_bound(spark, limit):
    fit(table(spark, SF, "documents"), table(spark, SF, "labels"), limit=limit)


def test_sampled_labels_keep_their_shares(spark):
    """A word of 80 % of the toxic tenth and 20 % of the rest is no verdict, however few rows of each label are read."""
    rows = [(i, i % 10 == 0, (i // 10) % 5 < (4 if i % 10 == 0 else 1)) for i in range(4000)]
    docs = spark.createDataFrame([(i, "the idiot came by again" if weak else "a quiet day went by") for i, _, weak in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(toxic)) for i, toxic, _ in rows], "doc_id long, toxic int")
    means = []
    for limit in (200, 6000):
        scores = [r["score"] for r in score_toxicity(docs, labels, limit=limit).collect()]
        assert max(scores) < 0.5
        means.append(sum(scores) / len(scores))
    assert abs(means[0] - means[1]) < 0.03 and abs(means[1] - 0.1) < 0.02
