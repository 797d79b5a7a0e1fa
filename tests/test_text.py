"""Text functions against Python's own string functions."""

import html
import re
import tracemalloc
import unicodedata

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.queries import QUERIES
from tidyshelf import lexicon as lx
from tidyshelf.functions import text as tx
from tidyshelf.functions.html_text import unescape_strip_compose
from tidyshelf.storage import BATCH_BYTES, BATCH_KEY, prepare_session

#: Own texts with what cleaning makes of them.
CLEANED = {
    "": "", " \u00a0 ": "", "plain words": "plain words", "  <h2>Desk</h2>\n\n\n\n<p>oak&nbsp;&amp;&nbsp;steel</p>": "Desk \n\n oak\u00a0&\u00a0steel",
    "<hr>": "", "&lt;em&gt;loud&lt;/em&gt;": "loud", "3 < 5 and 7 > 2": "3 2", "<style>p{}</style>": "p{}", "&amp;gt;": "&gt;",
    "&bogus; &euro 5 &#163;7 &#x41;": "&bogus; &euro 5 £7 A", "â‚¬ 5": "â‚¬ 5", "Ã¼ber": "über", "über raw": "über raw",
    "cafe\u0301": "café", "one\n\n\n\n\ntwo": "one\n\ntwo", "• a ▪ b": "a \n b", "“x” ‘y’ – — …": '"x" \'y\' - - ...',
    "\x01bell\x07 gone\x7f": "bell gone", ">\u0338 joined": "\u226f joined", "tab\t \tgap": "tab gap", "\r\n edge \r": "edge", "₹ 9 & 4 &": "₹ 9 & 4 &",
}
MESSY = [*CLEANED, "हिन्दी", "각", "Ǆ ǆ ß ﬁ", "rock'n'roll", "TV 32in s&p", "ΣΑΣ", "Ω Å", "　wide　", "\x1cfs\x1c"]


def test_clean_gives_the_written_texts(each):
    assert dict(zip(CLEANED, each(tx.clean_description, list(CLEANED)))) == CLEANED


def test_clean_column_equals_expression(spark, each):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MESSY)], "i INT, t STRING")
    rows = tx.clean_column(df, "t").orderBy("i").collect()
    assert [r["t"] for r in rows] == each(tx.clean_description, MESSY)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=30, max_size=60))
def test_clean_random(each, texts):
    """Whatever the text: composed, without control characters, blank runs or open ends."""
    for text in each(tx.clean_description, texts):
        assert text == text.strip() and "  " not in text and "\n\n\n" not in text
        assert not any(ord(c) < 32 and c not in "\t\n\r\x1c\x1d\x1e\x1f" for c in text)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aB&é'ß1 -.\xa0́हΩ"), max_size=12), min_size=30, max_size=60))
def test_title_and_strip_random(each, texts):
    assert each(tx.py_title, texts) == [t.title() for t in texts]
    assert each(tx.py_strip, texts) == [t.strip() for t in texts]


def test_steps_match_python(each):
    assert each(tx.remove_html, MESSY) == [re.sub("<[^>]+>", " ", html.unescape(t)) for t in MESSY]
    assert each(tx.normalize_unicode, MESSY) == [unicodedata.normalize("NFC", t) for t in MESSY]
    assert each(tx.sanitize_text, MESSY) == [re.sub(r"\s+", " ", t).strip() for t in MESSY]
    assert each(tx.py_title, MESSY) == [t.title() for t in MESSY]
    assert each(tx.has_text, MESSY) == [bool(t.strip()) for t in MESSY]


def test_a_batch_is_worked_on_in_pieces():
    """A batch of 40 MB takes a few MB of Python strings; nulls, empty and long texts keep their places."""
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else "&amp; <b>x</b>" + "cafe\u0301 " * (100_000 if i == 500 else 3500) for i in range(2500)]
    batch = pa.array(texts), pa.array(["html+nfc"] * len(texts))
    tracemalloc.start()
    made = []
    for piece in unescape_strip_compose.func(iter([batch, (batch[0].slice(0, 0), batch[1].slice(0, 0))])):
        made += [t if t is None else (len(t), t[:12]) for t in piece.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch[0].nbytes > 40e6 and peak < 12e6
    again = [t if t is None else unicodedata.normalize("NFC", re.sub("<[^>]+>", " ", html.unescape(t))) for t in texts]
    assert made == [t if t is None else (len(t), t[:12]) for t in again]


def test_batches_for_python_are_bounded_in_bytes(spark):
    """10,000 rows are no bound: texts differ in length. What the application sets stays."""
    @F.arrow_udf("long")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    def largest(session):
        return session.range(0, 4000, 1, 1).select(held(F.repeat(F.lit("e\u0301 "), 2000)).alias("n")).agg(F.max("n")).first()[0]

    session = prepare_session(spark.newSession())
    assert largest(session) < 5e6
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    assert largest(prepare_session(session)) < 1.5e6


def test_nfc_query_bounds_its_batches(spark, tmp_path):
    rows = [(1, "e\u0301 " * 90_000, 3), (2, None, 3), (3, "", 3), (4, "e\u0301", None)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_chars BIGINT").write.parquet(str(tmp_path / "documents.parquet"))
    session = spark.newSession()
    got = {r["doc_id"]: r["composed"] for r in QUERIES["nfc"](session, str(tmp_path)).collect()}
    assert session.conf.get(BATCH_KEY) == BATCH_BYTES
    assert got[2] is None and got[1].startswith("é é ") and len(got[1]) == 180_000 + len(got[3]) and "é" in got[4]


def test_settled_characters_need_no_composer():
    """Over all code points: what the pattern lets pass is composed and never joins with what stands before it."""
    settled = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)).replace("\\", "\\\\").replace("]", "\\]"), tx._SETTLED) + "]")
    pairs = [d.split() for d in (unicodedata.decomposition(chr(c)) for c in range(0x110000)) if d and "<" not in d]
    joining = {chr(int(pair[1], 16)) for pair in pairs if len(pair) == 2}
    for c in map(chr, range(0x110000)):
        if settled.match(c):
            assert unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) and c not in joining, hex(ord(c))
    assert settled.match("₹") and settled.match("•") and not settled.match("\u0301") and not settled.match("\u212b")


def test_lexicon_pairs():
    """Values written out by hand, so that a slip in the lexicon shows."""
    brands = {"apple": "Apple", "hp": "HP", "boat": "boAt", "h&m": "H&M", "levis": "Levi's"}
    for alias, canonical in brands.items():
        assert lx.BRAND_ALIASES.get(alias, canonical) == canonical
    assert lx.CURRENCY_CODES["usd"] == "USD" and lx.DEFAULT_CURRENCY == "INR" and lx.CURRENCY_CODES["rs"] == "INR"
    assert lx.CATEGORY_ALIASES["tv"] and lx.CATEGORY_ALIASES["laptop"] and lx.AVAILABILITY_ALIASES["in stock"] == "In Stock"


def test_encoding_not_repaired_beyond_latin1(each):
    assert each(tx.fix_encoding, ["â‚¹", "Ã©", "é", "Ã©₹", "Ã© "]) == ["â‚¹", "é", "é", "Ã©₹", "Ã© "]


def test_format_price(spark):
    rows = spark.sql("VALUES (1, 99999L, 'INR'), (2, 1000L, 'USD'), (3, NULL, 'INR'), (4, 5L, 'GBP'), (5, 1234567L, 'EUR') AS t(i, p, c)")
    shown = [r[0] for r in rows.orderBy("i").select(tx.format_price(F.col("p"), F.col("c"))).collect()]
    assert shown == ["₹99,999", "$1,000", "N/A", "GBP5", "€1,234,567"]
    assert rows.select(tx.format_price(F.col("p"))).first()[0].startswith("₹")


def test_fixed2_is_printf(spark):
    values = [0.0, 0.005, 0.015, 0.045, 0.125, 0.375, 0.305, 0.29, 0.4999, 0.145, 0.01, 0.3, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    got = [r[0] for r in df.orderBy("i").select(tx.fixed2(F.col("v"))).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_whitespace_set():
    assert set(lx.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert all(re.match(lx.WHITESPACE_CLASS.replace(r"\x20", " "), c) for c in lx.WHITESPACE)
