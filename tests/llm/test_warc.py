import gzip
import hashlib
import io

import pytest

from tests.conftest import SF
from tidyshelf.llm.common import table
from tidyshelf.llm.queries import op6_warc
from tidyshelf.llm.warc import read_records, read_warc, record_bytes, write_warc


def plain(rows, least=100):
    first = {}
    for i, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, html in rows:
        body = (html or "").encode()
        to = first.get(body) if i is not None else None
        revisit = to is not None and to != i
        out.append((None if i is None else str(i), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", str(to) if revisit else None))
    return sorted(out, key=str)


def measured(spark, df, folder, **options):
    records = read_warc(spark, write_warc(df, str(folder), **options), with_payload=False)
    return sorted((tuple(r) for r in records.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark, tmp_path):
    pages = table(spark, SF, "pages")
    assert measured(spark, pages, tmp_path) == plain([(r["page_id"], r["html"]) for r in pages.collect()])
    payloads = read_warc(spark, [str(p) for p in tmp_path.glob("*.warc.gz")]).select("payload").collect()
    assert sorted(r[0].decode() for r in payloads) == sorted(r["html"] for r in pages.collect())


def test_copies_odd_rows_and_small_archives(spark, tmp_path):
    body = "é" * 80
    rows = [(5, body), (3, body), (3, body), (9, body), (None, body), (1, "short"), (2, "short"), (4, None), (6, ""), (7, "x" * 100), (8, "x" * 100), (10, "y" * 300_000)]
    df = spark.createDataFrame([(i, "http://a\r\nb", h, h) for i, h in rows], "page_id long, url string, html string, digest string").repartition(2)
    assert measured(spark, df, tmp_path / "a", archive_bytes=200) == plain(rows)
    assert len(list((tmp_path / "a").glob("*"))) > 4
    assert write_warc(df.limit(0), str(tmp_path / "b")).count() == 0
    assert read_warc(spark, []).count() == 0
    assert measured(spark, df.select("page_id", "html"), tmp_path / "c", url_col=None) == plain(rows)


def test_one_member_per_record_and_broken_archives():
    digest = hashlib.sha256(b"body").hexdigest()
    one = record_bytes("response", "1", None, digest, b"body", 4)
    text = gzip.decompress(one)
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\nbody\r\n\r\n")
    assert [r["payload"] for r in read_records(io.BytesIO(one * 3))] == [b"body"] * 3
    for bad in (one[:-12], gzip.compress(text.replace(b"body", b"bodx")), gzip.compress(text.replace(b"Length: 4", b"Length: 3")),
                gzip.compress(text.replace(b"Length: 4", b"Length: 400")), gzip.compress(b"no record")):
        with pytest.raises(ValueError):
            list(read_records(io.BytesIO(bad)))


def test_query_with_odd_ids(spark, tmp_path):
    """The query itself, over null and repeated ids and columns that it does not read."""
    body = "é" * 80
    rows = [(5, body), (3, body), (3, body), (None, body), (None, None), (4, ""), (7, "short")]
    spark.createDataFrame([(i, None, h, "x", 1) for i, h in rows], "page_id long, url string, html string, digest string, record_id int").write.parquet(f"{tmp_path}/pages.parquet")
    got = op6_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    text = lambda x: None if x is None else str(x)
    assert sorted(((text(r[0]), *r[1:4], text(r[4])) for r in got), key=str) == plain(rows)


def test_ids_of_any_characters(spark, tmp_path):
    body = "z" * 120
    ids = ["a\r\nWARC-Type: x", "", "<b>", "ü %41", None]
    df = spark.createDataFrame([(i, None, body) for i in ids], "page_id string, url string, html string")
    assert measured(spark, df, tmp_path) == plain([(i, body) for i in ids])
