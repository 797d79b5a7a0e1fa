"""JSON extraction, price recovery, attempts and prompts."""

import json

import pytest
from pyspark.sql import functions as F

from tidyshelf.functions import json_text as js
from tidyshelf.functions import price as pr
from tidyshelf.operators import responses as rs


def objects(each, texts):
    out = each(lambda c: F.to_json(js.extract_json_object(c)), texts)
    return [None if r is None else json.loads(r) for r in out]


#: Own reply texts with the object that they hold.
REPLIES = {
    '{"maker": "Lumo", "cost": 12}': {"maker": "Lumo", "cost": 12}, '```json\n{"maker": "Orra"}\n```': {"maker": "Orra"},
    '```\n{"maker": "Pine"}\n```': {"maker": "Pine"}, 'As asked: {"name": "Tall shelf"} - end': {"name": "Tall shelf"},
    "There is nothing to extract.": None, "": None, '{"maker": "Lumo", "cost":': None, '{"box": {"w": 3}, "cost": 4}': {"box": {"w": 3}, "cost": 4},
    "[7, 8]": None, "null": None, '{"p":1} {"q":2}': None, '```json\n[4]\n``` {"p": 1}': None, '```\nsome words\n``` {"p": 1}': {"p": 1},
    '``` ``` {"p":1}': {"p": 1}, '{"p":1},"__end"] y': {"p": 1}, '{"p":1}]': {"p": 1}, '{"p":1},{"q":2}': None, '{"p":1,"p":2}': {"p": 2},
    '\xa0{"p":1} ': {"p": 1}, '```JSON {"p":1}```': {"p": 1}, "u } v {": None, "{}": {}, '```{"p":1}``` ```{"q":2}```': {"p": 1},
    '{"p":"```"}': {"p": "```"}, '"words"': None, "31": None,
}


def test_objects_in_replies(each):
    assert dict(zip(REPLIES, objects(each, list(REPLIES)))) == REPLIES
    assert objects(each, [None]) == [None]


def test_nonstandard_numbers_are_rejected(each):
    assert objects(each, ['{"a": NaN}', '{"a": Infinity}']) == [None, None]


#: Own texts with the price in them.
PRICES = {
    "": None, "Rs.2,350": 2350, "Rs 810": 810, "INR 4100": 4100, "INR\xa04100": 4100, "MRP: ₹3,400, Sale: ₹2,900": 2900, "@Rs.2,350 for two": 2350,
    "Price: 7100": 7100, "₹8,210": 8210, "Flat ₹300 OFF today": None, "Flat Rs.300 OFF Rs.300 Rs.275": 275, "Visitors 12": 12, "₹2,31,400": 231400,
    "₹6": None, "Rs.0 Rs.8": 8, "₹,4": None, "$19.50": None, "RS:44": None, "oak desk | ₹5,650 | ships Friday": 5650,
    "Name: Bench\nPrice: ₹1,02,030\nStock: few": 102030, "chair, blue": None,
}


def test_prices_in_texts(each):
    assert dict(zip(PRICES, each(pr.extract_price, list(PRICES)))) == PRICES


def test_price_beyond_bigint_is_skipped(each):
    assert each(pr.extract_price, ["Rs.99999999999999999999 Rs.5"]) == [5]


def attempts(spark, *rows):
    return spark.createDataFrame(rows, "id BIGINT, attempt INT, raw_output STRING")


GOOD = '{"brand": "Apple"}'


def test_resolution(spark):
    table = attempts(
        spark, (1, 1, GOOD), (2, 1, "bad"), (2, 2, GOOD), (3, 1, "no"), (3, 2, "not json"), (3, 3, None),
        (4, 1, None), (4, 2, GOOD), (5, 1, f"```json\n{GOOD}\n```"), (6, 1, None), (6, 2, None), (6, 3, None),
        (7, 4, GOOD), (8, 1, GOOD), (8, 2, '{"brand": "late"}'), (9, 1, "[1]"), (9, 2, "null"), (9, 3, "x"),
    )
    rows = {r["id"]: r for r in rs.resolve_attempts(table, 3).withColumn("parsed", F.to_json("parsed")).collect()}
    assert {i: (r["parsed"] is not None, r["retry_count"], r["llm_raw_output"]) for i, r in rows.items()} == {
        1: (True, 0, GOOD), 2: (True, 1, GOOD), 3: (False, 3, "not json"), 4: (True, 1, GOOD), 5: (True, 0, f"```json\n{GOOD}\n```"),
        6: (False, 3, None), 8: (True, 0, GOOD), 9: (False, 3, "x"),
    }


def test_one_failing_call_costs_one_attempt(spark):
    prompts = rs.build_prompts(spark.sql("SELECT id, concat('t', id) AS raw_description FROM range(10)").coalesce(1), "P {raw_description}")

    def ask(row):
        if row.id == 7 and row.attempt < 3 or row.id == 9:
            raise ConnectionError("refused")
        return None if row.id == 4 and row.attempt == 1 else "no" if row.id == 5 else '{"brand": "x"}'

    rows = rs.apply_extractor(prompts, ask, waits=(0.01,)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.attempt)):
        got.setdefault(r.id, []).append(r.raw_output)
    good = '{"brand": "x"}'
    assert got == {**{i: [good] for i in (0, 1, 2, 3, 6, 8)}, 4: [None, good], 5: ["no"] * 3, 7: [None, None, good], 9: [None] * 3}
    with pytest.raises(Exception, match="not a text or None"):
        rs.apply_extractor(prompts, lambda row: (row.id, 1, "x"))


def test_prompts(spark, tmp_path):
    path = tmp_path / "prompt.txt"
    path.write_text("Version 1:\n{raw_description}", encoding="utf-8")
    assert rs.load_template(spark, str(path)) == "Version 1:\n{raw_description}"
    path.write_text("Version 2: {raw_description}", encoding="utf-8")
    assert "Version 2" in rs.load_template(spark, str(path))
    with pytest.raises(FileNotFoundError):
        rs.load_template(spark, str(tmp_path / "nope.txt"))
    df = spark.createDataFrame([("iPhone {0} $1 \\1",)], "raw_description STRING")
    assert rs.build_prompts(df, "Parse: {raw_description}").first()["prompt"] == "Parse: iPhone {0} $1 \\1"
    assert rs.PLACEHOLDER in rs.default_template()
