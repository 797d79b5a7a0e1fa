"""Whole jobs, their invariants and the shape of their plans."""

import json
import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES, _attempts, _tagged, echo_extractor
from checks.views import table, view
from conftest import SF
from tidyshelf.config import PipelineConfig
from tidyshelf.functions.text import clean_column
from tidyshelf.operators import canonical as ca
from tidyshelf.operators import dedup as de
from tidyshelf.operators import distribution as di
from tidyshelf.operators import responses as rs
from tidyshelf.operators import summary as su
from tidyshelf.operators import validation as va
from tidyshelf.plans import jobs
from tidyshelf.plans.analytics import analytics
from tidyshelf.storage import Workspace, shared_folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_preprocess(spark):
    texts = ["  ", "<br>", "<b>x</b>", "x", "<p>", None, "y\xa0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "o INT, raw_description STRING")
    rows = [tuple(r) for r in jobs.preprocess(df, "o").orderBy("id").collect()]
    assert rows == [(1, 1, ""), (2, 2, "x"), (3, 6, "y")]


def test_preprocess_is_idempotent(spark):
    once = jobs.preprocess(view(spark, SF, "dirty").withColumnRenamed("dirty", "raw_description"), "doc_id")
    plain = once.filter(~F.col("raw_description").rlike("[&<]|^$"))
    again = jobs.preprocess(plain.drop("id"), "doc_id")
    assert again.select("doc_id", "raw_description").exceptAll(plain.select("doc_id", "raw_description")).isEmpty()
    assert again.count() == plain.count()


def test_normalize_one(spark):
    reply = json.dumps({"product_name": "Lamp", "brand": "ikea", "category": "sofa", "confidence": 0.9})
    done = jobs.normalize_one(spark, " <b>Lamp</b> Rs.500 ", 42, extractor=lambda row: reply)
    row = done.clean.first()
    assert (row["id"], row["brand"], row["category"], row["price"], row["raw_description"]) == (42, "IKEA", "Furniture", 500, "Lamp Rs.500")
    assert done.errors.isEmpty() and done.summary.first()["success_rate"] == 100.0
    failed = jobs.normalize_one(spark, "x", 7, attempts=spark.createDataFrame([], "id BIGINT, attempt INT, raw_output STRING"))
    assert failed.errors.first()["error_type"] == "json_parse_error"
    with pytest.raises(ValueError):
        jobs.normalize_one(spark, " \n ", extractor=echo_extractor)


def test_normalize_table_limit(spark):
    df = view(spark, SF, "listings").select("listing_id", "raw_description")
    done = jobs.normalize_table(df, extractor=echo_extractor, limit=10, order="listing_id")
    assert done.summary.first()["total"] == 10 and done.clean.count() + done.errors.count() == 10
    assert {r["id"] for r in done.tagged.select("id").collect()} == set(range(1, 11))
    with pytest.raises(ValueError):
        jobs.normalize_table(df, order="listing_id")
    with pytest.raises(ValueError, match="reply_key"):
        jobs.normalize_table(df, attempts=_attempts(spark, SF), order="listing_id")


def test_file_job_drops_its_workspace(spark, tmp_path):
    (tmp_path / "in.csv").write_text("description\n" + "\n".join(f"Lamp {i} Rs.{i}00" for i in range(1, 31)), encoding="utf-8")
    import os

    before = set(os.listdir(shared_folder(spark)))
    cfg = PipelineConfig(str(tmp_path / "in.csv"), str(tmp_path / "c"), str(tmp_path / "e"), limit=20, waits=())
    row = jobs.run_pipeline(spark, cfg, echo_extractor).first()
    assert (row["total"], row["success"], row["errors"], row["success_rate"]) == (20, 16, 4, 80.0)
    assert set(os.listdir(shared_folder(spark))) == before


def test_analytics_tables(spark):
    done = jobs.normalize_table(view(spark, SF, "listings").select("listing_id", "raw_description"),
                                attempts=_attempts(spark, SF), order="listing_id", reply_key="listing_id")
    raw = view(spark, SF, "listings").select("raw_description")
    charts = analytics(done.tagged, done.clean, raw, preprocessed=done.preprocessed)
    assert all(t.columns for t in charts.values()) and len(charts) == 17
    total = done.summary.first()
    assert sum(r["count"] for r in charts["category_counts"].collect()) == total["success"]
    assert sum(r["count"] for r in charts["error_counts"].collect()) == total["errors"]
    fast = analytics(done.tagged, done.clean, raw, approximate=True)
    assert fast["median_price"].first()[0] == pytest.approx(charts["median_price"].first()[0], rel=0.05)


def _rounded(df):
    row = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    return [row(r) for r in df.collect()]


def test_analytics_equal_the_operators_and_read_inputs_once(spark):
    """Charts from the table of counts are what the operators make of the rows, nulls and one row included."""
    rows = [(c, b, a, u, p, x, None) for c, b, a, u, p, x in [
        ("TV", "LG", "In Stock", "INR", 10, 0.5), ("TV", "LG", "In Stock", "INR", 10, 0.9), ("TV", None, "Soon", None, None, 0.4),
        ("Mobile", "Vivo", "Unknown", "USD", 2**53 + 1, None), (None, "vivo", None, "XXX", 7, 1.0), ("TV", "Sony", "In Stock", "INR", 900, 0.75)]]
    clean = spark.createDataFrame(rows, "category string, brand string, availability string, currency string, price long, confidence double, error_type string")
    tagged = clean.select("error_type").unionByName(spark.createDataFrame([("x",), ("x",), ("y",)], "error_type string"))
    raw = spark.createDataFrame([("aa",), ("aa",), (None,), (None,), ("b",), ("",)], "raw_description string")
    for part in (clean, clean.limit(0)):
        with Workspace(spark) as work:
            inputs = [work.freeze(df, "input") for df in (tagged, part, raw, raw.filter("raw_description IS NOT NULL"))]
            t, c, r, kept = inputs
            charts = analytics(t, c, r, preprocessed=kept, threshold=0.6, workspace=work)
            lengths = r.selectExpr("char_length(raw_description) AS length")
            errors = t.filter("error_type IS NOT NULL")
            want = {
                "run_summary": su.run_summary(t), "avg_confidence": su.average_confidence(c), "category_counts": su.value_counts(c, "category"),
                "availability_counts": su.value_shares(c, "availability"), "error_counts": su.value_counts(errors, "error_type"),
                "top_brands": su.top_k(c, "brand", 15), "success_failure": su.success_failure(t), "histogram_price": di.histogram(c, "price", 30),
                "histogram_confidence": di.histogram(c, "confidence", 20), "box_stats": di.box_stats(c), "median_price": di.median(c, "price"),
                "below_threshold": su.below_threshold(c, 0.6), "enum_conformance": va.enum_conformance(c), "histogram_length": di.histogram(lengths, "length", 40),
                "describe_length": di.describe(lengths, "length"), "duplicates": de.duplicate_report(r, "raw_description"),
                "stage_counts": su.stage_counts(r, kept, t)}
            assert list(charts) == list(want)
            for name, expected in want.items():
                assert charts[name].columns == expected.columns, name
                assert sorted(_rounded(charts[name]), key=str) == sorted(_rounded(expected), key=str), name
                read = set(charts[name].inputFiles())
                assert read and not read & {f for df in inputs for f in df.inputFiles()}, name


def test_frozen_tables_are_written_below_the_shared_folder(spark):
    with Workspace(spark) as work:
        frozen = work.freeze(spark.range(5), "x")
        assert work.root.startswith(shared_folder(spark)) and frozen.count() == 5


def test_no_plan_needs_one_partition_or_a_cross_join(spark):
    """Windows run per partition key or over slice totals; joins have keys."""
    for name in ("postprocess_job", "category_by_join", "join_replies", "resolve_attempts", "dedup_exact", "dedup_rows", "minimum_slice"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
        assert "SinglePartition" not in text or name == "category_by_join", name  # the set of alias lengths is one row


def test_dimensions_are_broadcast(spark):
    text = plan(ca.postprocess(va.split(_tagged(spark, SF))[0]))
    assert text.count("BroadcastHashJoin") >= 2


def test_one_python_stage_before_the_extractor(spark):
    text = plan(clean_column(table(spark, SF, "documents").select("text"), "text"))
    assert text.count("ArrowEvalPython") == 1


def test_resolution_shuffles_once(spark):
    text = plan(rs.resolve_attempts(_attempts(spark, SF)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_dedup_shuffles_once_and_combines_first(spark):
    text = plan(de.dedup_exact(table(spark, SF, "documents").select("doc_id", "text"), "text", "doc_id"))
    assert text.count("Exchange") == 1 and "partial_min" in text and "SortAggregate" not in text


def test_rules_are_computed_once(spark):
    """A filter on the outcome must not pull copies of the rules below it."""
    whole, part = plan(_tagged(spark, SF)), plan(va.split(_tagged(spark, SF))[1])
    assert part.count("try_variant_get") <= whole.count("try_variant_get")


def test_scans_prune_columns(spark):
    text = plan(su.top_k(table(spark, SF, "lineitem"), "l_suppkey", 5))
    assert "ReadSchema: struct<l_suppkey:bigint>" in text and "TakeOrderedAndProject" in text


def test_missing_reply_is_a_parse_error(spark):
    raw = view(spark, SF, "listings").select(F.col("listing_id").alias("id"), "raw_description")
    tried = _attempts(spark, SF).filter(F.col("id") % 17 != 0)
    lost = va.validate(rs.join_replies(raw, rs.resolve_attempts(tried))).filter(F.col("id") % 17 == 0)
    assert lost.filter(F.col("error_type") != "json_parse_error").isEmpty() and lost.first()["retry_count"] == 0


def test_scan_partitions_deal_the_input(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "o INT, raw_description STRING").coalesce(1)
    assert jobs.preprocess(df, "o", scan_partitions=4).count() == 50


def test_csv_without_line_breaks_in_records_is_split(spark, tmp_path):
    from tidyshelf.sources.readers import read_listings

    (tmp_path / "in.csv").write_text("title\n" + "\n".join(f"lamp {i}" for i in range(4000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        split = read_listings(spark, str(tmp_path / "in.csv"), multiline=False)
        parts = split.select(F.spark_partition_id()).distinct().count()
        titles = [r["title"] for r in split.orderBy("src_ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 2 and titles == [f"lamp {i}" for i in range(4000)]


def test_replies_belong_to_their_listing(spark):
    """Numbers shift where equal texts collapse; replies follow the key of the first row."""
    rows = [(10, "red lamp"), (11, "red lamp"), (12, "blue chair"), (13, " "), (14, "desk")]
    df = spark.createDataFrame(rows, "listing_id BIGINT, raw_description STRING")
    reply = '{"product_name": "item", "brand": "b%d", "category": "x", "confidence": 0.9}'
    attempts = spark.createDataFrame([(k, 1, reply % k) for k, _ in rows], "id BIGINT, attempt INT, raw_output STRING")
    done = jobs.normalize_table(df, attempts=attempts, columns=["raw_description"], order="listing_id", reply_key="listing_id", limit=2)
    assert sorted((r["id"], r["raw_description"], r["brand"]) for r in done.clean.collect()) == [(1, "red lamp", "B10"), (2, "blue chair", "B12")]
    stages = su.stage_counts(df, done.preprocessed, done.tagged)
    assert {r["stage"]: r["rows"] for r in stages.collect()} == {"raw": 5, "preprocessed": 3, "clean": 2, "errors": 0}


def test_shares_read_their_input_once(spark):
    text = su.value_shares(table(spark, SF, "customer"), "c_mktsegment")
    assert sum(r["percent"] for r in text.collect()) == pytest.approx(100, abs=0.5)


def test_few_rows_need_the_unescaper(spark):
    """Only texts with an ampersand visit Python: no listing without one holds what composing could change."""
    from tidyshelf.functions import text as tx

    listings = view(spark, SF, "listings").select(tx.fix_encoding(F.col("raw_description")).alias("t"))
    visits = listings.filter(tx._has_entity(F.col("t")) | tx._may_compose(F.col("t")))
    assert visits.filter(~F.contains("t", F.lit("&"))).isEmpty() and not visits.isEmpty()
