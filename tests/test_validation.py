"""Field rules, routing and canonical values."""

import json

import pytest
from pyspark.sql import functions as F

from tidyshelf import lexicon as lx
from tidyshelf.operators import canonical as ca
from tidyshelf.operators import validation as va
from tidyshelf.operators.columns import conform
from tidyshelf.schemas import CLEAN_SCHEMA

VALID = {
    "product_name": "Apple iPhone 15 128GB", "brand": "Apple", "category": "Mobile", "price": 79999, "currency": "INR",
    "offer": "Flat Rs.5000 off with HDFC Card", "availability": "In Stock", "delivery": "Ships Tomorrow", "seller": "Appario Retail",
    "confidence": 0.95,
}
NOTHING = object()


def reply(**changes):
    body = {**VALID, **changes}
    return {k: v for k, v in body.items() if v is not NOTHING}


@pytest.fixture
def check(spark):
    def run(*replies, threshold=0.5, text="raw text", **options):
        rows = [(i, text, None if r is None else json.dumps(r), 2, "raw") for i, r in enumerate(replies)]
        df = spark.createDataFrame(rows, "id BIGINT, raw_description STRING, j STRING, retry_count INT, llm_raw_output STRING")
        return va.validate(df.withColumn("parsed", F.parse_json("j")), threshold, **options).orderBy("id").collect()

    return run


def codes(row):
    return [(v["field"], v["type"]) for v in row["violations"]]


def test_valid_row(check):
    row = check(reply())[0]
    assert {k: row[k] for k in VALID} == VALID and row["processing_status"] == "success" and row["error_type"] is None


def test_prices(check):
    given = ["79,999", "₹ 12,500", None, -500, 12.9, -0.5, True, "INR 24990", "N/A", "1e3", "1_000", " 7 ", "inf", "nan", [5], {"a": 1}, "5d", "Rs 500", "", "-3", 10**30, "+5", ".5", "5."]
    want = [79999, 12500, None, -500, 12, 0, 1, 24990, None, 1000, 1000, 7, None, None, None, None, None, 500, None, -3, None, 5, 0, 5]
    assert [r["price"] for r in check(*[reply(price=p) for p in given])] == want


def test_price_with_rs_dot(check):
    texts = [reply(price="Rs.1,499"), reply(price="Rs. 1,499")]
    assert [r["price"] for r in check(*texts)] == [1499, 1499]
    assert [r["price"] for r in check(*texts, strict_compat=True)] == [0, None]


def test_missing_price_comes_from_text(check):
    rows = check(reply(price=None), reply(price=NOTHING), reply(price="N/A"), text="Rs.1,499 only")
    assert [r["price"] for r in rows] == [1499, 1499, None]


def test_currencies(check):
    given = ["rs", "₹", " USD ", "€", "gbp", None, NOTHING, 5, "Rupees", "$"]
    assert [r["currency"] for r in check(*[reply(currency=c) for c in given])] == ["INR", "INR", "USD", "EUR", "INR", "INR", "INR", "INR", "INR", "USD"]


def test_confidence(check):
    given = [1.5, -0.1, "0.9", "high", None, True, "nan", "inf", "-inf", [1], " 0.75 ", 0.5]
    rows = check(*[reply(confidence=c) for c in given])
    assert [r["confidence"] for r in rows] == [1.0, 0.0, 0.9, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.75, 0.5]
    assert [r["error_type"] for r in rows] == [None, "low_confidence", None, "low_confidence", "low_confidence", None, None, None, "low_confidence", "low_confidence", None, None]
    assert codes(check(reply(confidence=NOTHING))[0]) == [("confidence", "missing")]


def test_names(check):
    given = ["  Lamp ", 12, True, 1.5, 12.0, 0, False, None, [], {}, "", " ", "x", NOTHING]
    rows = check(*[reply(product_name=n) for n in given])
    assert [r["product_name"] for r in rows[:5]] == ["Lamp", "12", "True", "1.5", "12.0"]
    types = [dict(codes(r)).get("product_name") for r in rows]
    assert types == ["string_too_short" if n in ("", " ", "x") and isinstance(n, str) else t for n, t in zip(given, [None] * 5 + ["string_type"] * 5 + ["short"] * 3 + ["missing"])]


def test_all_violations_at_once(check):
    row = check({"brand": "", "price": -1, "availability": None, "seller": 5, "offer": []})[0]
    assert codes(row) == [
        ("product_name", "missing"), ("brand", "string_too_short"), ("category", "missing"), ("price", "greater_than_equal"),
        ("offer", "string_type"), ("availability", "string_type"), ("seller", "string_type"), ("confidence", "missing"),
    ]
    assert row["error_type"] == "validation_error" and json.loads(row["error_detail"])[0]["msg"] == "Field required"


def test_optional_and_default_fields(check):
    row = check(reply(offer=None, seller=NOTHING, delivery=None, availability=NOTHING, category=""))[0]
    assert (row["offer"], row["seller"], row["delivery"], row["availability"], row["category"]) == (None, None, None, "Unknown", "")
    assert row["error_type"] is None
    assert check(reply(availability=None))[0]["error_type"] == "validation_error"


def test_routing(check):
    rows = check(None, {}, {"brand": "Apple"}, reply(confidence=0.01), reply(confidence=0.5), reply(confidence=0.125))
    assert [r["error_type"] for r in rows] == ["json_parse_error", "validation_error", "validation_error", "low_confidence", None, "low_confidence"]
    assert rows[3]["error_detail"] == "Confidence 0.01 < threshold 0.50" and rows[5]["error_detail"] == "Confidence 0.12 < threshold 0.50"
    assert rows[0]["error_detail"] == va.PARSE_ERROR_DETAIL
    assert all(r["raw_description"] == "raw text" and r["retry_count"] == 2 for r in rows)


def test_clean_rows_have_name_and_brand(check):
    rows = check(*[reply(product_name=n, brand=b) for n in ("", "ab", " ") for b in ("", "c", None)])
    assert all(r["product_name"] and r["brand"] for r in rows if r["error_type"] is None)


def test_split_is_a_partition(spark):
    from checks.queries import _tagged
    from conftest import SF

    tagged = _tagged(spark, SF)
    clean, errors = va.split(tagged)
    assert clean.schema.fieldNames() == CLEAN_SCHEMA.fieldNames()
    assert clean.count() + errors.count() == tagged.count() and clean.join(errors, "id").isEmpty()


@pytest.fixture
def canon(spark):
    def run(fn, column, *values, **options):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {column} STRING")
        return [r[column] for r in fn(df, **options).orderBy("i").collect()]

    return run


def test_brands(canon):
    given = ["apple", "APPLE", "samsung", "somenewbrand", " H&M ", "o'neil", "one plus", "1+", "BRAND#17 x"]
    assert canon(ca.normalize_brand, "brand", *given) == ["Apple", "Apple", "Samsung", "Somenewbrand", "H&M", "O'Neil", "OnePlus", "OnePlus", "Brand#17 X"]


CATEGORIES = ["smartphone", "Cellphone", "phone", "earbuds", "TWS", "Headset", "wireless headphones", "tablet", "garden tools", " e-book reader", "", "Ultra OLED tv"]


def test_categories(canon):
    want = ["Mobile", "Mobile", "Mobile", "Headphones", "Headphones", "Headphones", "Mobile", "Furniture", "Garden Tools", "Book", "", "TV"]
    assert canon(ca.normalize_category, "category", *CATEGORIES) == want


def test_category_join_agrees_with_scan(canon, spark):
    dim = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(lx.CATEGORY_ALIASES.items())], "ord INT, alias STRING, canonical STRING")
    assert canon(ca.normalize_category, "category", *CATEGORIES, dim=dim) == canon(ca.normalize_category, "category", *CATEGORIES)


def test_availability(canon):
    given = ["available", "YES", "sold out", "only 5 left", "pre-order", "Only 12 left!!", " Ask seller ", "Hurry", "we have only 5 left"]
    want = ["In Stock", "In Stock", "Out of Stock", "Limited Stock", "Coming Soon", "Limited Stock", "Ask seller", "Limited Stock", "we have only 5 left"]
    assert canon(ca.normalize_availability, "availability", *given) == want


def test_own_dimension(canon):
    assert canon(ca.normalize_brand, "brand", "acme co", dim={"acme co": "ACME"}) == ["ACME"]
    many = {f"alias {i}": f"Brand {i}" for i in range(20_000)}  # one plan at every size
    assert canon(ca.normalize_brand, "brand", " Alias 19999 ", "ALIAS 20000", dim=many) == ["Brand 19999", "Alias 20000"]


def test_offer_seller_currency(each):
    assert each(ca.normalize_offer, ["  10%   off\n now ", "   ", "", None]) == ["10% off now", None, None, None]
    assert each(ca.normalize_seller, [" big bazaar ", "   ", "", None]) == ["Big Bazaar", "", None, None]
    assert each(ca.normalize_currency_case, ["usd", "", None]) == ["USD", "INR", "INR"]


def test_conform_adds_absent_columns(spark):
    df = conform(spark.sql("SELECT '7' AS id, 'x' AS brand, 1 AS other"), CLEAN_SCHEMA)
    assert df.schema.simpleString() == CLEAN_SCHEMA.simpleString() and df.first()["id"] == 7


def test_map_sizes():
    assert [len(m) for m in (lx.BRAND_ALIASES, lx.CATEGORY_ALIASES, lx.AVAILABILITY_ALIASES)] == [88, 66, 24]
    assert [len(set(m.values())) for m in (lx.BRAND_ALIASES, lx.CATEGORY_ALIASES, lx.AVAILABILITY_ALIASES)] == [73, 11, 5]
