"""Readers, writers, columns, order and duplicates."""

import json

import pytest
from pyspark.sql import functions as F

from tidyshelf.operators import columns as co
from tidyshelf.operators import dedup as de
from tidyshelf.operators import ordering as od
from tidyshelf.schemas import CLEAN_COLUMNS, ERROR_COLUMNS, CLEAN_SCHEMA, ERROR_SCHEMA
from tidyshelf.sources.readers import read_listings, require_rows
from tidyshelf.sources.publish import read_published
from tidyshelf.sources.writers import export_results, publish_results, write_clean, write_errors, write_jsonl


def table(df):
    return [tuple(r) for r in df.orderBy("src_ord").drop("src_ord").collect()]


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿Title,Item Description,Note\nA,"two\nlines, ""quoted""",NA\n  B ,₹5,\nC,null,None\nD,x,N/A y\n', encoding="utf-8")
    df = read_listings(spark, str(path))
    assert df.columns == ["Title", "Item Description", "Note", "src_ord"]
    assert table(df) == [("A", 'two\nlines, "quoted"', ""), ("  B ", "₹5", ""), ("C", "", ""), ("D", "x", "N/A y")]
    assert co.pick_description_column(df).columns == ["Title", "raw_description", "Note", "src_ord"]


def test_csv_keeps_file_order(spark, tmp_path):
    rows = [f"r{i:05d}" for i in range(20_000)]
    (tmp_path / "big.csv").write_text("name\n" + "\n".join(rows), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        for multiline in (True, False):
            df = read_listings(spark, str(tmp_path / "big.csv"), multiline=multiline)
            assert [r[0] for r in table(df)] == rows
        assert df.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_and_jsonl(spark, tmp_path):
    records = [{"title": "A", "brand": None, "n": 5, "deep": {"x": 1}}, {"title": "ü", "brand": "b", "n": 1.5, "extra": "e"}]
    (tmp_path / "a.json").write_text(json.dumps(records, ensure_ascii=False, indent=1), encoding="utf-8")
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in records), encoding="utf-8")
    for name in ("a.json", "a.jsonl"):
        df = read_listings(spark, str(tmp_path / name))
        assert df.columns == ["title", "brand", "n", "deep", "extra", "src_ord"]
        assert table(df) == [("A", "", "5", '{"x":"1"}', ""), ("ü", "b", "1.5", "", "e")]


def test_format_errors(spark, tmp_path):
    with pytest.raises(ValueError, match=r"\.csv, \.json, \.jsonl"):
        read_listings(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(FileNotFoundError):
        read_listings(spark, str(tmp_path / "none.csv"))
    (tmp_path / "UP.CSV").write_text("a\n1\n", encoding="utf-8")
    assert read_listings(spark, str(tmp_path / "UP.CSV")).count() == 1
    (tmp_path / "header.csv").write_text("a,b\n", encoding="utf-8")
    with pytest.raises(ValueError):
        require_rows(read_listings(spark, str(tmp_path / "header.csv")))


def test_writers(spark, tmp_path):
    clean = spark.createDataFrame([(1, ' "q", x\n', "ü ")], "id BIGINT, product_name STRING, brand STRING")
    write_clean(clean, str(tmp_path / "c"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*")).decode("utf-8")
    assert text.startswith("﻿id,product_name,brand,category,price,currency,")
    back = read_listings(spark, str(tmp_path / "c"), fmt="csv")
    assert back.columns == [*CLEAN_COLUMNS, "src_ord"] and back.first()[:3] == ("1", ' "q", x\n', "ü ")
    write_clean(clean, str(tmp_path / "p"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "p")).dtypes == spark.createDataFrame([], CLEAN_SCHEMA).dtypes
    write_errors(spark.createDataFrame([], ERROR_SCHEMA), str(tmp_path / "e"))
    header = b"".join(p.read_bytes() for p in (tmp_path / "e").glob("part-*")).decode("utf-8-sig")
    assert header.strip() == ",".join(ERROR_COLUMNS)
    write_jsonl(clean, str(tmp_path / "j"))
    write_jsonl(clean, str(tmp_path / "j"))
    lines = [x for p in (tmp_path / "j").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 2 and "ü" in lines[0]


def test_large_csv_is_read_by_many_tasks(spark, tmp_path):
    """One writing task makes several files, as records over lines keep a file in one reading task."""
    rows = spark.range(0, 70_000, 1, 1).select("id", F.format_string('line "%d",\nnext', "id").alias("raw_description"))
    for name, write in (("e.csv", write_errors), ("c.csv", write_clean)):
        write(rows, str(tmp_path / name))
        back = read_listings(spark, str(tmp_path / name))
        sizes = back.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 4 and max(r["count"] for r in sizes) <= 20_000
        got = [(r["id"], r["raw_description"]) for r in back.orderBy("src_ord").select("id", "raw_description").collect()]
        assert got == [(str(i), f'line "{i}",\nnext') for i in range(70_000)]


def test_order_beyond_a_thousand_files_of_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidyshelf.sources.writers.FILE_ROWS", 1)
    write_errors(spark.range(0, 1020, 1, 1), str(tmp_path / "e.csv"))
    assert len(list((tmp_path / "e.csv").glob("part-*"))) == 1020
    back = read_listings(spark, str(tmp_path / "e.csv"))
    assert [r["id"] for r in back.orderBy("src_ord").collect()] == [str(i) for i in range(1020)]


def test_export_counts(spark, tmp_path):
    clean = spark.range(3).withColumn("brand", F.lit("b"))
    result = export_results(clean, spark.range(1), str(tmp_path / "c"), str(tmp_path / "e"))
    assert (result.total, result.success, result.errors, result.success_rate) == (4, 3, 1, 75.0)
    nothing = export_results(spark.range(0), spark.range(0), str(tmp_path / "c"), str(tmp_path / "e"))
    assert (nothing.total, nothing.success_rate) == (0, 0.0)


def _broken(spark, n):
    """A table whose last row cannot be computed."""
    return spark.range(n).withColumn("brand", F.when(F.col("id") < n - 1, F.lit("new")).otherwise(F.raise_error(F.lit("no more"))))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_failing_export_leaves_both_old_tables(spark, tmp_path, fmt):
    c, e = str(tmp_path / "c"), str(tmp_path / "e")
    read = lambda p: sorted(r["id"] for r in (spark.read.parquet(p) if fmt == "parquet" else read_listings(spark, p, fmt="csv").withColumn("id", F.col("id").cast("long"))).collect())
    export_results(spark.range(3), spark.range(1), c, e, fmt)
    for clean, errors in ((spark.range(9), _broken(spark, 4)), (_broken(spark, 4), spark.range(9))):
        with pytest.raises(Exception, match="no more"):
            export_results(clean, errors.withColumn("raw_description", F.col("brand")) if "brand" in errors.columns else errors, c, e, fmt)
        assert read(c) == [0, 1, 2] and read(e) == [0] and sorted(p.name for p in tmp_path.iterdir()) == ["c", "e"]
    with pytest.raises(Exception, match="no more"):
        write_clean(_broken(spark, 3), c, fmt)
    assert read(c) == [0, 1, 2]
    export_results(spark.range(5), spark.range(2), c, e, fmt)
    assert len(read(c)) == 5 and len(read(e)) == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["c", "e"]


@pytest.mark.parametrize("steps", range(5))
def test_export_cut_short_is_finished(spark, tmp_path, monkeypatch, steps):
    """The job dies after so many renames; the next look at the tables finds both new ones."""
    from tidyshelf.sources import publish

    c, e = str(tmp_path / "c"), str(tmp_path / "e")
    export_results(spark.range(3), spark.range(1), c, e, "parquet")
    done, rename = [], publish.Files.rename

    def dying(self, source, target):
        if len(done) >= steps:
            raise KeyboardInterrupt
        rename(self, source, target)
        done.append(target)

    with monkeypatch.context() as m:
        m.setattr(publish.Files, "rename", dying)
        if steps < 4:
            with pytest.raises(KeyboardInterrupt):
                export_results(spark.range(9), spark.range(8), c, e, "parquet")
        else:
            export_results(spark.range(9), spark.range(8), c, e, "parquet")
    assert publish.recover(spark, c, e) == (steps < 4)
    assert spark.read.parquet(c).count() == 9 and spark.read.parquet(e).count() == 8
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c", "e"]


def test_published_runs(spark, tmp_path):
    """Both tables become current together; a failing run changes nothing, and readers of the last run go on."""
    root = str(tmp_path / "r")
    publish_results(spark.range(3), spark.range(1), root)
    first = read_published(spark, root)
    with pytest.raises(Exception, match="no more"):
        publish_results(spark.range(9), _broken(spark, 4).withColumn("raw_description", F.col("brand")), root)
    assert [read_published(spark, root)[n].count() for n in ("clean", "errors")] == [3, 1]
    publish_results(spark.range(5), spark.range(2), root)
    assert [read_published(spark, root)[n].count() for n in ("clean", "errors")] == [5, 2]
    assert first["clean"].count() == 3 and read_published(spark, root)["clean"].columns == CLEAN_COLUMNS
    publish_results(spark.range(1), spark.range(1), root)
    assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("run-")]) == 2


def test_repeated_append_counts_once(spark, tmp_path):
    path = str(tmp_path / "j")
    rows = lambda: sorted((r["run"], r["id"]) for r in spark.read.schema("id long, run string").json(path).collect())
    for _ in range(2):
        write_jsonl(spark.range(3), path, run="2024-01-01 a/b")
    write_jsonl(spark.range(2), path, run="other")
    assert rows() == [("2024-01-01 a/b", i) for i in range(3)] + [("other", i) for i in range(2)]
    with pytest.raises(Exception, match="no more"):
        write_jsonl(_broken(spark, 4), path, run="other")
    write_jsonl(spark.range(1), path, run="2024-01-01 a/b")
    assert rows() == [("2024-01-01 a/b", 0), ("other", 0), ("other", 1)]
    write_jsonl(spark.range(0), path, run="other")
    assert rows() == [("2024-01-01 a/b", 0)]


def test_column_detection(spark):
    df = spark.createDataFrame([("1", " ", "x", None, "y")], "sku STRING, Title STRING, Brand_Name STRING, memo STRING, zeta STRING")
    assert co.detect_description_columns(df) == ["Brand_Name", "sku", "zeta"]
    assert co.detect_description_columns(df.withColumn("raw_description", F.lit(""))) == ["raw_description"]
    blank = spark.createDataFrame([(" ", "")], "a STRING, item STRING")
    assert co.detect_description_columns(blank) == ["item", "a"]
    assert co.resolve_columns(df, "zeta, nope ,sku") == ["zeta", "sku"]
    with pytest.raises(ValueError):
        co.resolve_columns(df, "nope")
    assert co.pick_description_column(df).columns[0] == "raw_description"


def test_build_description(spark):
    df = spark.createDataFrame([("A", " NaN ", "₹5"), ("", "None", None)], "title STRING, list_price STRING, price2b STRING")
    got = [r["raw_description"] for r in co.build_description(df, ["title", "list_price", "price2b"]).collect()]
    assert got == ["Title: A\nPrice2B: ₹5", ""]
    plain = co.build_description(df, ["title", "price2b"], labeled=False).first()["raw_description"]
    assert plain == "A\n₹5"
    lone = spark.createDataFrame([("as is",)], "raw_description STRING")
    assert co.build_description(lone, ["raw_description"]).first()[0] == "as is"


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 50_000).select((F.col("id") * 7919 % 50_000).alias("k"), F.lit(1).alias("hot"), F.lit(9).alias("id"))
    numbered = od.assign_ids(df, ["hot", "k"])
    bad = numbered.filter(F.col("id") != F.col("k") + 1).count()
    assert numbered.count() == 50_000 and bad == 0 and numbered.columns == ["id", "k", "hot"]
    assert od.assign_ids(df.limit(0), "k").count() == 0


def test_ids_by_an_id_column(spark):
    df = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "id BIGINT, v STRING")
    assert sorted(tuple(r) for r in od.assign_ids(df, "id").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_dedup_keeps_the_first(spark):
    df = spark.range(30_000).select(
        F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("t"),
        (F.col("id") * 2).alias("twice"))
    got = {r["t"]: (r["o"], r["twice"]) for r in de.dedup_exact(df, "t", "o").collect()}
    want = {}
    for i in range(30_000):
        want.setdefault("hot" if i % 3 == 0 else f"t{i % 100}", (i, 2 * i))
    assert got == want
    assert {r["t"]: r["o"] for r in de.dedup_exact(df.select("o", "t"), "t", "o").collect()} == {k: v[0] for k, v in want.items()}


def test_duplicate_report(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "t STRING")
    assert tuple(de.duplicate_report(df, "t").first()) == (5, 2, 2)
