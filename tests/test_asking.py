"""Calls in flight, their rate, and the ledger of answers."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidyshelf.operators import responses as rs
from tidyshelf.operators.asking import Ledger


@pytest.fixture
def prompts(spark):
    return lambda n: spark.range(n).select("id", F.concat(F.lit("text "), "id").alias("raw_description")).withColumn("prompt", F.col("raw_description"))


def noted(folder, seconds=0.0, fails=(), dies=None):
    """An extractor that notes each call in a file of its own; at call number ``dies`` its process ends without a word."""
    os.makedirs(folder, exist_ok=True)

    def ask(row):
        began = time.time()
        if dies is not None and len(os.listdir(folder)) >= dies:
            os._exit(1)
        time.sleep(seconds)
        with open(f"{folder}/{row.id}-{row.attempt}-{time.time_ns()}", "w") as out:
            json.dump([began, time.time()], out)
        if row.id in fails:
            raise ConnectionError("no answer")
        return json.dumps({"brand": row.prompt})

    return ask


def calls(folder):
    return Counter(tuple(map(int, name.split("-")[:2])) for name in os.listdir(folder))


def times(folder):
    return [json.loads(open(f"{folder}/{name}").read()) for name in os.listdir(folder)]


def test_calls_in_flight(prompts, tmp_path):
    """20 calls of 100 ms in one task overlap, a failing one costs its own row an attempt, and answers keep their rows."""
    ask = noted(str(tmp_path / "c"), 0.1, fails={7})
    rows = rs.apply_extractor(prompts(20), ask, partitions=1, retry_limit=1, in_flight=20).collect()
    assert {r.id: r.raw_output for r in rows} == {i: None if i == 7 else json.dumps({"brand": f"text {i}"}) for i in range(20)}
    spans = times(tmp_path / "c")
    assert max(e for _, e in spans) - min(b for b, _ in spans) < 0.9
    few = noted(str(tmp_path / "d"), 0.05)
    rs.apply_extractor(prompts(12), few, partitions=1, in_flight=3)
    spans = times(tmp_path / "d")
    assert max(sum(b <= at < e for b, e in spans) for at, _ in spans) <= 3


def test_rate_is_shared_over_tasks(prompts, tmp_path):
    rs.apply_extractor(prompts(24), noted(str(tmp_path / "c")), partitions=2, in_flight=8, rate=20.0, retry_limit=1)
    begun = sorted(b for b, _ in times(tmp_path / "c"))
    assert begun[-1] - begun[0] > 0.8
    assert max(sum(at <= b < at + 0.5 for b in begun) for at in begun) <= 14


def test_a_wrong_answer_ends_the_job(prompts):
    with pytest.raises(Exception, match="not a text or None"):
        rs.apply_extractor(prompts(8), lambda row: 5 if row.id == 3 else "x", partitions=1, in_flight=4)


def test_killed_job_never_asks_twice(spark, prompts, tmp_path):
    """The worker dies after half the calls; the next run asks for the others only, a third one for nothing."""
    folder, ledger = str(tmp_path / "calls"), Ledger(str(tmp_path / "ledger"), commit_rows=1)
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a dead worker
        rs.apply_extractor(prompts(40), noted(folder, dies=20), partitions=1, ledger=ledger)
    assert len(calls(folder)) == 20 and ledger.answers(spark).count() == 20
    want = {i: json.dumps({"brand": f"text {i}"}) for i in range(40)}
    for _ in range(2):
        rows = rs.apply_extractor(prompts(40), noted(folder), partitions=3, ledger=ledger, in_flight=4).collect()
        assert {r.id: r.raw_output for r in rows} == want and len(rows) == 40
        assert calls(folder) == {(i, 1): 1 for i in range(40)}
    ledger.compact(spark)
    assert ledger.answers(spark).count() == 40 and not [n for n in os.listdir(tmp_path / "ledger") if n.startswith("round-")]
    rs.apply_extractor(prompts(41), noted(folder), partitions=3, ledger=ledger)
    assert sum(calls(folder).values()) == 41


def test_lost_task_takes_over_its_record(spark, tmp_path):
    """The record of a task's earlier try is read, whole files only."""
    from tidyshelf.operators.asking import _Record

    first = _Record(f"file:{tmp_path}/round/0", 2)
    for i in range(5):
        first.add(f"k{i}", 1, None if i == 1 else f"a{i}")
    (tmp_path / "round/0/_torn.parquet").write_bytes(b"PAR1")
    assert _Record(f"file:{tmp_path}/round/0", 2).known() == {"k0": "a0", "k1": None, "k2": "a2", "k3": "a3"}
    assert Ledger(str(tmp_path / "round")).answers(spark).count() == 4


def test_failures_and_equal_prompts(spark, tmp_path):
    """Failed calls are on record by attempt; equal prompts are asked once and answer all their rows."""
    folder, ledger = str(tmp_path / "calls"), Ledger(str(tmp_path / "ledger"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, raw_description string").withColumn("prompt", F.col("raw_description"))
    for _ in range(2):
        rows = rs.apply_extractor(df, noted(folder, fails={2}), retry_limit=2, waits=(), ledger=ledger).collect()
        assert sorted((r.id, r.attempt, r.raw_output) for r in rows) == [
            (1, 1, '{"brand": "a"}'), (2, 1, None), (2, 2, None), (3, 1, '{"brand": "a"}'), (4, 1, '{"brand": null}')]
        assert calls(folder) == {(1, 1): 1, (2, 1): 1, (2, 2): 1, (4, 1): 1}
