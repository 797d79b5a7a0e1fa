import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm import quality_rules
from tidyshelf.llm.common import table
from tidyshelf.llm.quality_rules import judge_documents


def plain(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def measured(df):
    return [tuple(r)[1:7] for r in judge_documents(df).collect()]


@pytest.mark.parametrize("bits", [20, 3])
def test_counts(spark, odd, empty, monkeypatch, bits):
    """With few bits for a window's hash and place, the exact way takes over."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", bits)
    docs = table(spark, SF, "documents")
    assert sorted(measured(docs)) == sorted(plain(r["text"]) for r in docs.collect())
    assert sorted(measured(odd)) == sorted(map(plain, ODD_TEXTS)) and judge_documents(empty).count() == 0


def test_verdict_follows_the_labels(spark):
    rows = judge_documents(table(spark, SF, "documents")).join(table(spark, SF, "labels"), "doc_id").filter("NOT base_failed").collect()
    assert rows and all(r["kept"] == (r["quality"] == 1) for r in rows)


#: Lines whose windows of three words are all different.
GOOD = "\n".join(f"A{i} plain{i} sentence number {i} that{i} says{i} something{i} new{i} about item {i * 7}." for i in range(8))


def test_failed_lines_go(spark):
    lines = {"menu": "Home | News | Sport | Shop", "shout": "BUY THIS THING NOW", "marks": "wow!! so!! cheap!!", "litter": "a### b*** c$$$ d%%%", "site": "Read more about us"}
    df = spark.createDataFrame([(n, f"{GOOD}\n{x}\n{x}") for n, x in lines.items()] + [("clean", GOOD)], "doc_id string, text string")
    for r in judge_documents(df, cleaned=True).collect():
        assert r["clean_text"] == GOOD and r["kept"] and (r["lost_words"] > 0) == (r["doc_id"] != "clean")
    flood = spark.createDataFrame([(1, GOOD + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(40)))], "doc_id long, text string")
    row = judge_documents(flood).first()
    assert not row["base_failed"] and not row["kept"]
    prose = f"{GOOD}\nHe had to log in again before the page would show him what he had come for."
    assert judge_documents(spark.createDataFrame([(1, prose)], "doc_id long, text string"), cleaned=True).first()["clean_text"] == prose


def test_filters_and_joins_do_not_open_the_plan(spark):
    """A filter on the verdict leaves every stage as it is."""
    docs = table(spark, SF, "documents")
    plain_plan, size = judge_documents(docs), lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    for df in (plain_plan.filter("kept"), plain_plan.filter("NOT base_failed AND lost_words = 0"), docs.join(plain_plan.filter("kept"), "doc_id")):
        assert size(df) < 1.5 * size(plain_plan)
    rows = {r["doc_id"] for r in plain_plan.collect() if r["kept"]}
    assert {r["doc_id"] for r in plain_plan.filter("kept").collect()} == rows


def test_late_and_uncommon_capitals_shout(spark):
    """Capitals among a line's last characters, and cased characters that are no letters."""
    good = "\n".join(f"A plain sentence number {i} that says something new about item {i * 7}." for i in range(8))
    lines = ["1 2 3 4 5 6 7 8 9 X", "1 2 \u2163", "\u24b6 - \u24b7 -", "1 2 \u01c4", "\u0130 1 2"]
    df = spark.createDataFrame([(i, f"{x}\nabc\n{good}") for i, x in enumerate(lines)], "doc_id long, text string")
    for r in judge_documents(df, cleaned=True).collect():
        assert r["clean_text"] == f"abc\n{good}" and r["lost_words"] == len(lines[r["doc_id"]].split())
    rows = "\n".join(f"{i} {i + 1} {i + 2} {i * 3} {i * 5} X\nabc{i}" for i in range(100, 140))
    row = judge_documents(spark.createDataFrame([(1, rows)], "doc_id long, text string")).first()
    assert row["lost_words"] == 240 and not row["base_failed"] and not row["kept"]


def test_pre_filter_misses_no_line(spark, monkeypatch):
    rng = random.Random(4)
    bits = ["a", "X", "7", "É", "é", "\u2163", "\u24d0", "\u24b6", "\u01c5", "ß", "\u03a3", "\u03c2", " ", " ", " ", "\t", "\n", "\n", "-", "|", "#", "!", "?", "click here", "Log In"]
    weights = [4] * 19 + [0.2] * 6
    texts = ["".join(rng.choices(bits, weights, k=rng.randrange(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quick = judge_documents(df, cleaned=True).orderBy("doc_id").collect()
    monkeypatch.setattr(quality_rules, "_suspect", lambda *_: F.lit(True))
    assert quick == judge_documents(df, cleaned=True).orderBy("doc_id").collect() and any(r["lost_words"] for r in quick)
