"""The registered queries: each runs one operator or job over whole driver tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import dealt, table, view
from tidyshelf import lexicon as lx
from tidyshelf.functions import json_text as js
from tidyshelf.functions import price as pr
from tidyshelf.functions import text as tx
from tidyshelf.operators import canonical as ca
from tidyshelf.operators import columns as co
from tidyshelf.operators import dedup as de
from tidyshelf.operators import distribution as di
from tidyshelf.operators import ordering as od
from tidyshelf.operators import responses as rs
from tidyshelf.operators import sketches as sk
from tidyshelf.operators import summary as su
from tidyshelf.operators import validation as va
from tidyshelf.operators.asking import Ledger
from tidyshelf.plans import jobs
from tidyshelf.plans.analytics import analytics
from tidyshelf.config import PipelineConfig
from tidyshelf.sources.readers import read_listings
from tidyshelf.sources.publish import read_published
from tidyshelf.sources.writers import publish_results, write_clean, write_errors, write_jsonl
from tidyshelf.schemas import CLEAN_SCHEMA, ERROR_SCHEMA, PRODUCT_FIELDS
from tidyshelf.storage import Workspace, prepare_session, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
THRESHOLD = 0.5
SHORT_TEMPLATE = "Listing: {raw_description}\nAnswer with {\"brand\": ...} only."


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare_session(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/checks-{uuid.uuid4().hex}"


# ---- text ------------------------------------------------------------------------------------

def _on(view_name: str, key: str, source: str, target: str, fn) -> Query:
    return lambda spark, d: view(prepare_session(spark), d, view_name).select(key, fn(F.col(source)).alias(target))


QUERIES["fix_encoding"] = _on("mojibake", "doc_id", "garbled", "fixed", tx.fix_encoding)
QUERIES["nfc"] = _on("dirty", "doc_id", "dirty", "composed", tx.normalize_unicode)
QUERIES["control_chars"] = _on("dirty", "doc_id", "dirty", "kept", tx.remove_control_chars)
QUERIES["bullets"] = _on("dirty", "doc_id", "dirty", "lines", tx.normalize_bullets)
QUERIES["punctuation"] = _on("dirty", "doc_id", "dirty", "plain", tx.normalize_punctuation)
QUERIES["whitespace"] = _on("dirty", "doc_id", "dirty", "spaced", tx.normalize_whitespace)
QUERIES["sanitize_text"] = _on("dirty", "doc_id", "dirty", "sane", tx.sanitize_text)


@query
def remove_html(spark, d):
    return table(spark, d, "pages").select("page_id", tx.remove_html(F.col("html")).alias("plain"))


@query
def clean_description(spark, d):
    return tx.clean_column(dealt(view(spark, d, "dirty")), "dirty").withColumnRenamed("dirty", "cleaned")


@query
def clean_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return tx.clean_column(dealt(pages), "html").withColumnRenamed("html", "cleaned")


@query
def py_title(spark, d):
    return view(spark, d, "listings").select(
        "listing_id", tx.py_title(F.concat_ws(" ", "brand_txt", "category_txt", "avail_txt")).alias("titled"))


@query
def format_price(spark, d):
    price = F.when(F.col("listing_id") % 5 != 0, F.col("price_int") * 1234)
    codes = F.array(*[F.lit(c) for c in ("INR", "USD", "EUR", "GBP")])
    code = F.get(codes, (F.col("listing_id") % 4).cast("int"))
    return view(spark, d, "listings").select("listing_id", tx.format_price(price, code).alias("shown"))


@query
def text_length(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.text_length(F.col("text")).cast("bigint").alias("chars"))


# ---- sources, columns, filters ---------------------------------------------------------------

@query
def pick_column(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("Long_DESCRIPTION"), "source")
    return co.pick_description_column(df)


@query
def pick_first_column(spark, d):
    return co.pick_description_column(table(spark, d, "supplier").select("s_name", "s_suppkey"))


@query
def fill_missing(spark, d):
    df = view(spark, d, "attempts").withColumn(
        "note", F.when(F.col("attempt") == 1, "N/A").when(F.col("attempt") == 2, "null").otherwise("kept"))
    return co.fill_missing(df, na_tokens=True)


@query
def csv_round_trip(spark, d):
    """Clean-shaped rows, written as CSV with a byte order mark and read back in file order."""
    path = f"{scratch(spark)}/clean.csv"
    listings = view(spark, d, "listings").select(
        F.col("listing_id").alias("id"), F.col("brand_txt").alias("brand"),
        F.concat(F.lit(' say "hi",\n'), "raw_description", F.lit("  ")).alias("raw_description"))
    write_clean(listings, path)
    return read_listings(spark, path).select("id", "brand", "offer", "raw_description")


@query
def errors_round_trip(spark, d):
    path = f"{scratch(spark)}/errors.csv"
    write_errors(view(spark, d, "attempts").select(
        F.col("listing_id").alias("id"), F.col("attempt").alias("retry_count"),
        F.col("raw_output").alias("llm_raw_output")), path)
    return read_listings(spark, path).drop("src_ord")


@query
def jsonl_round_trip(spark, d):
    path = f"{scratch(spark)}/rows.jsonl"
    rows = view(spark, d, "attempts").select(F.col("raw_output").alias("z_text"), "listing_id", "attempt")
    write_jsonl(rows.filter(F.col("attempt") == 1), path)
    write_jsonl(rows.filter(F.col("attempt") > 1), path)
    return read_listings(spark, path, fmt="jsonl").drop("src_ord")


@query
def jsonl_repeated_runs(spark, d):
    """Two runs, the first of which is repeated: its rows are there once."""
    path = f"{scratch(spark)}/rows.jsonl"
    rows = view(spark, d, "attempts").select("listing_id", "attempt", "raw_output")
    write_jsonl(rows.filter(F.col("attempt") == 1), path, run="first")
    write_jsonl(rows.filter(F.col("attempt") > 1), path, run="others")
    write_jsonl(rows.filter(F.col("attempt") == 1), path, run="first")
    return spark.read.schema("listing_id long, attempt int, raw_output string, run string").json(path)


@query
def published_results(spark, d):
    """Rows of both tables as published: the second run is the current one."""
    root, tagged = f"{scratch(spark)}/published", _tagged(spark, d)
    with Workspace(spark) as work:
        clean, errors = va.split(work.freeze(tagged, "tagged"))
        publish_results(clean.filter("id % 2 = 0"), errors.limit(0), root)
        publish_results(clean, errors, root)
    tables = read_published(spark, root)
    rows = [df.select("id", "raw_description", F.lit(name).alias("table_name")) for name, df in tables.items()]
    return rows[0].unionByName(rows[1])


@query
def detect_columns(spark, d):
    df = table(spark, d, "customer").select(
        "c_custkey", F.lit("  ").alias("c_title"), "c_mktsegment", "c_name", F.lit(None).cast("string").alias("c_memo"))
    found = co.detect_description_columns(df)
    probe = df.agg(F.count("*").alias("rows_seen"))
    names = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column_name")) for i, c in enumerate(found)])
    return probe.select("rows_seen", F.inline(names))


def _customer_texts(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", "c_name", F.col("c_nationkey").alias("home_nation"),
        F.when(F.col("c_custkey") % 4 == 0, " NaN ").when(F.col("c_custkey") % 4 == 1, "  ")
        .otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("market_segment2b"))


@query
def build_description(spark, d):
    df = co.build_description(_customer_texts(spark, d), ["market_segment2b", "c_name", "home_nation"])
    return df.select("c_custkey", "raw_description")


@query
def build_description_plain(spark, d):
    df = co.build_description(_customer_texts(spark, d), ["c_name", "market_segment2b"], labeled=False)
    return df.select("c_custkey", "raw_description")


@query
def resolve_columns(spark, d):
    customer = table(spark, d, "customer")
    return customer.select(*co.resolve_columns(customer, "c_name, nope,c_custkey"))


@query
def drop_empty(spark, d):
    """All texts, and for each a blank row and a null row beside it."""
    blank = F.explode(F.array(F.col("text"), F.lit(" \u00a0 \t\n"), F.lit(None).cast("string")))
    return co.drop_empty(table(spark, d, "conversations").select("conv_id", "turn", blank.alias("raw_description")))


@query
def conform_clean(spark, d):
    df = view(spark, d, "listings").select(
        "raw_description", F.col("price_int").alias("price"), F.col("listing_id").alias("id"), F.col("brand_txt").alias("brand"))
    return co.conform(df, CLEAN_SCHEMA)


@query
def conform_errors(spark, d):
    df = view(spark, d, "attempts").select(
        F.col("attempt").cast("string").alias("retry_count"), F.col("listing_id").alias("id"), "raw_output",
        F.col("raw_output").alias("llm_raw_output"))
    return co.conform(df, ERROR_SCHEMA)


@query
def to_raw(spark, d):
    docs = table(spark, d, "documents")
    return co.to_raw(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw_description"), "lang"))


@query
def filter_confidence(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("confidence"))
    return co.filter_confidence(lines, 0.05)


@query
def numeric_price(spark, d):
    """All prices, and for each a word and a null beside it."""
    price = F.explode(F.array(F.col("price_int").cast("string"), F.lit("N/A"), F.lit(None).cast("string")))
    return co.numeric_not_null(view(spark, d, "listings").select("listing_id", price.alias("price")), "price")


# ---- order, duplicates, top-k ----------------------------------------------------------------

@query
def assign_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return od.assign_ids(docs, ["lang", "source", "doc_id"])


@query
def assign_ids_orders(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderkey")
    return od.assign_ids(orders, ["o_totalprice", "o_orderkey"])


@query
def dedup_exact(spark, d):
    return de.dedup_exact(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query
def dedup_rows(spark, d):
    chats = table(spark, d, "conversations").withColumn("text", F.lower("text"))
    return de.dedup_exact(chats, "text", ["conv_id", "turn"])


@query
def dedup_hot_rows(spark, d):
    """Seven texts for all rows: every group is hot."""
    lines = table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                                               F.concat_ws("/", "l_returnflag", "l_linestatus").alias("flags"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return de.dedup_exact(lines, "flags", order).select("flags", *order)


@query
def head_after_dedup(spark, d):
    docs = de.dedup_exact(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return od.head(docs, 100, "doc_id")


@query
def preview(spark, d):
    df = co.build_description(table(spark, d, "customer"), ["c_name", "c_mktsegment"])
    return od.preview(df.select("c_custkey", "raw_description"), 10, "c_custkey")


@query
def top_suppliers(spark, d):
    return su.top_k(table(spark, d, "lineitem"), "l_suppkey", 15)


@query
def preprocess_job(spark, d):
    dirty = view(spark, d, "dirty").withColumnRenamed("dirty", "raw_description")
    return jobs.preprocess(dealt(dirty), "doc_id").select("id", "doc_id", "raw_description")


@query
def preprocess_chats(spark, d):
    """All texts, and for each conversation a row that cleaning empties."""
    chats = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("raw_description"))
    dirt = chats.filter("turn = 0").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("<br>").alias("raw_description"))
    chats = chats.unionByName(dirt)
    return jobs.preprocess(chats, ["conv_id", "turn"]).select("id", "conv_id", "turn", "raw_description")


# ---- JSON and prices -------------------------------------------------------------------------

@query
def extract_json(spark, d):
    parsed = js.extract_json_object(F.col("raw_output"))
    return view(spark, d, "attempts").withColumn("p", parsed).select(
        "listing_id", "attempt", F.col("p").isNotNull().alias("is_object"),
        js.field_text(F.col("p"), "brand").alias("brand"))


@query
def extract_json_odd(spark, d):
    parsed = js.extract_json_object(F.col("raw_output"))
    return view(spark, d, "odd_replies").withColumn("p", parsed).select(
        "listing_id", F.col("p").isNotNull().alias("is_object"), js.field_text(F.col("p"), "category").alias("category"))


@query
def strict_json(spark, d):
    text = F.concat("props", F.when(F.col("event_id") % 3 == 0, " trailing").when(F.col("event_id") % 3 == 1, " \n").otherwise(""))
    v = js.strict_json(text)
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query
def json_kinds(spark, d):
    p = F.col("p")
    fields = ["product_name", "brand", "category", "price", "currency", "offer", "seller", "confidence"]
    odd = view(spark, d, "odd_replies").withColumn("p", js.extract_json_object(F.col("raw_output")))
    kind = {n: js.json_kind(js.field(p, n)) for n in fields}
    number = ("BIGINT", "DECIMAL", "DOUBLE")
    return odd.filter(p.isNotNull()).select(
        "listing_id", *[F.when(k.isin(*number), "NUMBER").otherwise(k).alias(n) for n, k in kind.items()])


@query
def extract_price(spark, d):
    return view(spark, d, "price_texts").select("listing_id", pr.extract_price(F.col("txt")).alias("price"))


@query
def extract_price_listings(spark, d):
    return view(spark, d, "listings").select("listing_id", pr.extract_price(F.col("raw_description")).alias("price"))


@query
def discount_amounts(spark, d):
    return view(spark, d, "price_texts").select("listing_id", F.explode(pr.discount_amounts(F.col("txt"))).alias("amount"))


@query
def fill_price(spark, d):
    listings = view(spark, d, "listings")
    given = F.when(F.col("listing_id") % 2 == 0, F.col("price_int").cast("string"))
    return listings.select("listing_id", rs.fill_price(given, F.col("raw_description")).alias("price"))


# ---- prompts and replies ---------------------------------------------------------------------

@query
def build_prompts(spark, d):
    listings = view(spark, d, "listings").select("listing_id", "raw_description")
    return rs.build_prompts(listings, SHORT_TEMPLATE).select("listing_id", "prompt")


def _attempts(spark, d):
    return view(spark, d, "attempts").withColumnRenamed("listing_id", "id")


def _resolved(spark, d):
    return rs.resolve_attempts(dealt(_attempts(spark, d)), 3)


@query
def resolve_attempts(spark, d):
    return _resolved(spark, d).select(
        "id", F.col("parsed").isNotNull().alias("answered"), "retry_count", "llm_raw_output",
        js.field_text(F.col("parsed"), "brand").alias("brand"))


@query
def resolve_two_attempts(spark, d):
    return rs.resolve_attempts(_attempts(spark, d), 2).select(
        "id", F.col("parsed").isNotNull().alias("answered"), "retry_count", "llm_raw_output")


def echo_extractor(row):
    """A stand-in for a model: every third id fails once, every fifth answers with prose only."""
    if row.id % 3 == 0 and row.attempt == 1:
        raise ConnectionError("no answer")
    if row.id % 5 == 0:
        return "no idea"
    brands, categories = ("apple", "one plus", "H&M", "acme"), ("tv", "Gaming Laptop", "wireless headphones", "garden tools", "smartphone")
    return json.dumps({"product_name": row.raw_description, "brand": brands[row.id % 4], "category": categories[row.id % 7 % 5],
                       "confidence": 0.9}, ensure_ascii=False)


@query
def apply_extractor(spark, d):
    """Attempts after mixed failures: one call that fails costs one attempt of one row."""
    raw = view(spark, d, "listings").select(F.col("listing_id").alias("id"), "raw_description")
    return rs.apply_extractor(rs.build_prompts(raw, SHORT_TEMPLATE), echo_extractor, partitions=8, waits=())


@query
def extractor_ledger(spark, d):
    """Attempts of two jobs with one ledger: the second asks for the listings with odd ids only."""
    raw = view(spark, d, "listings").select(F.col("listing_id").alias("id"), F.concat("listing_id", F.lit(" "), "raw_description").alias("raw_description"))
    prompts, ledger = rs.build_prompts(raw, SHORT_TEMPLATE), Ledger(f"{scratch(spark)}/ledger", commit_rows=500)
    rs.apply_extractor(prompts.filter("id % 2 = 0"), echo_extractor, partitions=8, waits=(), ledger=ledger, in_flight=4)

    def odd_only(row):
        if row.id % 2 == 0:
            raise AssertionError("asked twice")
        return echo_extractor(row)

    return rs.apply_extractor(prompts, odd_only, partitions=8, waits=(), ledger=ledger, in_flight=4)


def _answered(spark, d):
    """Every listing with its reply."""
    raw = view(spark, d, "listings").select(F.col("listing_id").alias("id"), "raw_description")
    return rs.join_replies(raw, rs.resolve_attempts(dealt(_attempts(spark, d)), 3))


@query
def join_replies(spark, d):
    """Listings divisible by 17 never got a reply."""
    raw = view(spark, d, "listings").select(F.col("listing_id").alias("id"), "raw_description")
    tried = dealt(_attempts(spark, d).filter(F.col("id") % 17 != 0))
    return rs.join_replies(raw, rs.resolve_attempts(tried, 3)).select(
        "id", "raw_description", F.col("parsed").isNotNull().alias("answered"), "retry_count", "llm_raw_output")


# ---- validation ------------------------------------------------------------------------------

def _odd(spark, d):
    tried = view(spark, d, "odd_replies").select(
        F.col("listing_id").alias("id"), F.lit(1).alias("attempt"), "raw_output")
    raw = view(spark, d, "listings").select(F.col("listing_id").alias("id"), "raw_description")
    return rs.resolve_attempts(tried, 3).join(raw, "id")


def _typed(spark, d, **options):
    return va.typed_fields(_odd(spark, d), **options).filter(F.col("parsed").isNotNull())


@query
def coerce_price(spark, d):
    return _typed(spark, d).select("id", "price")


@query
def coerce_price_strict(spark, d):
    return _typed(spark, d, strict_compat=True).select("id", "price")


@query
def currency(spark, d):
    return _typed(spark, d).select("id", "currency")


@query
def confidence(spark, d):
    return _typed(spark, d).select("id", "confidence")


@query
def stripped_fields(spark, d):
    return _typed(spark, d).select("id", "product_name", "brand", "category")


@query
def optional_fields(spark, d):
    return _typed(spark, d).select("id", "offer", "seller", "delivery", "availability")


def _exploded(tagged):
    return tagged.select("id", F.explode("violations").alias("v")).select(
        "id", F.col("v.field").alias("field"), F.col("v.type").alias("type"), F.col("v.msg").alias("msg"))


@query
def violations(spark, d):
    return _exploded(va.validate(_odd(spark, d)))


@query
def violations_replies(spark, d):
    return _exploded(_tagged(spark, d))


def _tagged(spark, d):
    return va.validate(_answered(spark, d), THRESHOLD)


@query
def validate_route(spark, d):
    return _tagged(spark, d).select("id", "error_type", "processing_status")


@query
def validate_route_odd(spark, d):
    return va.validate(_odd(spark, d), 0.4).select("id", "error_type")


@query
def error_detail(spark, d):
    tagged = va.validate(_odd(spark, d), 0.4).unionByName(_tagged(spark, d))
    return tagged.filter(F.col("error_type").isNotNull()).select("id", "error_type", "error_detail")


@query
def split_clean(spark, d):
    return va.split(_tagged(spark, d))[0]


@query
def split_errors(spark, d):
    return va.split(_tagged(spark, d))[1]


@query
def enum_conformance(spark, d):
    clean = va.split(_tagged(spark, d))[0]
    return va.enum_conformance(clean).withColumn("share", F.round("share", 6))


# ---- canonical values ------------------------------------------------------------------------

def _named(spark, d, source, target):
    return view(spark, d, "listings").select("listing_id", F.concat(F.lit(" "), source).alias(target))


@query
def brand(spark, d):
    return ca.normalize_brand(_named(spark, d, "brand_txt", "brand"))


@query
def category(spark, d):
    return ca.normalize_category(_named(spark, d, "category_txt", "category"))


@query
def category_by_join(spark, d):
    """The way for long dimensions: an equi-join on substrings instead of a scan of the aliases."""
    rows = [(i, a, c) for i, (a, c) in enumerate(lx.CATEGORY_ALIASES.items())]
    dim = spark.createDataFrame(rows, "ord INT, alias STRING, canonical STRING")
    return ca.normalize_category(_named(spark, d, "category_txt", "category"), dim)


@query
def category_many_aliases(spark, d):
    """An alias table that grows with the data, with repeated aliases: the first in order counts."""
    parts = table(spark, d, "part")
    names = parts.select((2 * F.col("p_partkey")).alias("ord"), F.lower("p_name").alias("alias"), F.concat(F.lit("P"), "p_partkey").alias("canonical"))
    again = parts.select((2 * F.col("p_partkey") + 1).alias("ord"), F.lower("p_name").alias("alias"), F.lit("never").alias("canonical"))
    listings = parts.select("p_partkey", F.concat(F.lit(" The "), "p_name", F.lit(" x")).alias("category"))
    return ca.normalize_category(listings, names.unionByName(again))


@query
def brand_many_aliases(spark, d):
    """As many aliases as parts, each twice."""
    name = F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"))
    parts = table(spark, d, "part").select("p_partkey", name.alias("brand"))
    first = parts.select((2 * F.col("p_partkey")).alias("ord"), F.lower("brand").alias("alias"), F.concat(F.lit("B"), "p_partkey").alias("canonical"))
    again = parts.select((2 * F.col("p_partkey") + 1).alias("ord"), F.lower("brand").alias("alias"), F.lit("never").alias("canonical"))
    return ca.normalize_brand(parts, first.unionByName(again))


@query
def availability(spark, d):
    return ca.normalize_availability(_named(spark, d, "avail_txt", "availability"))


@query
def offer(spark, d):
    text = F.when(F.col("s_suppkey") % 4 == 0, "  ").when(F.col("s_suppkey") % 4 == 1, "").when(
        F.col("s_suppkey") % 4 == 2, F.concat(F.lit(" 10%  \n off "), "s_name", F.lit(" ")))
    return table(spark, d, "supplier").select("s_suppkey", ca.normalize_offer(text).alias("offer"))


@query
def seller(spark, d):
    text = F.when(F.col("s_suppkey") % 4 == 0, "  ").when(F.col("s_suppkey") % 4 == 1, "").when(
        F.col("s_suppkey") % 4 == 2, F.concat(F.lit(" o'NEIL & sons "), "s_name"))
    return table(spark, d, "supplier").select("s_suppkey", ca.normalize_seller(text).alias("seller"))


@query
def currency_case(spark, d):
    code = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "usd")
    return table(spark, d, "customer").select("c_custkey", ca.normalize_currency_case(code).alias("currency"))


@query
def postprocess_job(spark, d):
    return ca.postprocess(va.split(_tagged(spark, d))[0])


# ---- whole jobs ------------------------------------------------------------------------------

def _normalized(spark, d):
    listings = view(spark, d, "listings").select("listing_id", "raw_description")
    return jobs.normalize_table(
        dealt(listings), attempts=_attempts(spark, d), columns=["raw_description"], order="listing_id", reply_key="listing_id")


@query
def normalize_table_job(spark, d):
    return _normalized(spark, d).clean


@query
def normalize_table_errors(spark, d):
    return _normalized(spark, d).errors


@query
def normalize_merged_job(spark, d):
    """Columns merged with labels; the detection finds them."""
    df = view(spark, d, "listings").select("listing_id", F.col("category_txt").alias("kind"), F.col("raw_description").alias("title"))
    done = jobs.normalize_table(df, attempts=_attempts(spark, d), order="listing_id", reply_key="listing_id")
    return done.clean.select("id", "raw_description", "brand", "price")


@query
def listing_files_job(spark, d):
    """Listing files in, both tables out, with a stand-in extractor; then the summary."""
    folder = scratch(spark)
    listings = view(spark, d, "listings").orderBy("listing_id")
    listings.select("listing_id", "raw_description").write.option("header", True).option("escape", '"').csv(f"{folder}/in.csv")
    cfg = PipelineConfig(f"{folder}/in.csv", f"{folder}/clean", f"{folder}/errors", extractor_partitions=8, waits=(), scan_partitions=8)
    summary = jobs.run_pipeline(spark, cfg, echo_extractor)
    return summary.drop("duration_seconds")


@query
def listing_files_clean(spark, d):
    """The clean table that the file job writes, as read back from Parquet."""
    folder = scratch(spark)
    view(spark, d, "listings").orderBy("listing_id").select("listing_id", "raw_description").write.json(f"{folder}/in.jsonl")
    cfg = PipelineConfig(f"{folder}/in.jsonl", f"{folder}/clean", f"{folder}/errors", output_format="parquet", waits=())
    jobs.run_pipeline(spark, cfg, echo_extractor)
    return spark.read.parquet(f"{folder}/clean")


@query
def json_column_order(spark, d):
    """A folder whose largest file is not its first, and whose first record holds 70 objects."""
    folder = f"{scratch(spark)}/in.jsonl"
    parts = table(spark, d, "part").orderBy("p_partkey").coalesce(1)
    nested = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.struct(i.alias("n"))))
    line = lambda *columns: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in columns]), F.lit("}"))
    name, key = F.concat(F.lit('"'), "p_name", F.lit('"')), F.col("p_partkey").cast("string")
    parts.filter("p_partkey % 10 = 1").select(line(("specs", nested), ("title", name), ("aaa", key))).write.text(f"{folder}/a")
    parts.filter("p_partkey % 10 <> 1").select(line(("aaa", key), ("title", name), ("specs", nested))).write.text(f"{folder}/b")
    rows = read_listings(spark, f"{folder}/*", fmt="jsonl").drop("src_ord")
    names = F.lit(",".join(rows.columns)).alias("names")
    return rows.select(F.col("aaa").cast("long").alias("p_partkey"), "title", F.length("specs").cast("long").alias("specs_length"), names)


@query
def normalize_one_text(spark, d):
    """One text of the table through all stages: the last, with its attempts."""
    row = view(spark, d, "listings").orderBy(F.desc("listing_id")).first()
    tried = _attempts(spark, d).filter(F.col("id") == row["listing_id"])
    done = jobs.normalize_one(spark, row["raw_description"], row["listing_id"], attempts=tried)
    return done.tagged.select("id", "raw_description", "brand", "price", "error_type", "retry_count")


# ---- analytics -------------------------------------------------------------------------------

def _clean(spark, d):
    return ca.postprocess(va.split(_tagged(spark, d))[0])


@query
def run_summary(spark, d):
    return su.run_summary(_tagged(spark, d))


@query
def avg_confidence(spark, d):
    return su.average_confidence(_clean(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query
def category_counts(spark, d):
    return su.value_counts(_clean(spark, d), "category")


@query
def segment_counts(spark, d):
    return su.value_counts(table(spark, d, "customer"), "c_mktsegment")


@query
def availability_counts(spark, d):
    return su.value_shares(_clean(spark, d), "availability")


@query
def error_counts(spark, d):
    return su.value_counts(va.split(_tagged(spark, d))[1], "error_type")


@query
def top_brands(spark, d):
    return su.top_k(_clean(spark, d), "brand", 15)


@query
def success_failure(spark, d):
    return su.success_failure(_tagged(spark, d))


def _rounded(h):
    return h.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query
def histogram_price(spark, d):
    return _rounded(di.histogram(_clean(spark, d), "price", 30))


@query
def histogram_confidence(spark, d):
    return _rounded(di.histogram(_clean(spark, d), "confidence", 20))


def _lengths(spark, d):
    return table(spark, d, "documents").select(tx.text_length(F.col("text")).alias("length"))


@query
def histogram_length(spark, d):
    return _rounded(di.histogram(_lengths(spark, d), "length", 40))


@query
def histogram_orders(spark, d):
    return _rounded(di.histogram(table(spark, d, "orders"), "o_totalprice", 30))


@query
def describe_length(spark, d):
    return di.describe(_lengths(spark, d), "length")


@query
def describe_orders(spark, d):
    return di.describe(table(spark, d, "orders"), "o_totalprice")


@query
def duplicates(spark, d):
    """All texts, and as many rows without one as there are ninth turns."""
    chats = table(spark, d, "conversations").select("turn", "text")
    missing = chats.filter("turn % 9 = 8").select("turn", F.lit(None).cast("string").alias("text"))
    return de.duplicate_report(chats.unionByName(missing), "text")


def _box_round(df):
    return df.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query
def box_stats(spark, d):
    return _box_round(di.box_stats(_clean(spark, d)))


@query
def box_stats_lines(spark, d):
    return _box_round(di.box_stats(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 8))


@query
def box_outliers(spark, d):
    orders = table(spark, d, "orders").withColumn("skewed", F.round(F.pow(F.col("o_totalprice") / 100000, F.lit(4)), 2))
    return di.box_outliers(orders, "o_orderpriority", "skewed", 3)


@query
def median_price(spark, d):
    return di.median(_clean(spark, d), "price")


@query
def growing_quantiles(spark, d):
    """States of one batch of orders per year, stored and merged: exact ends, and whether each quartile's rank is as stated."""
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    path, by = f"{scratch(spark)}/states", ["o_orderpriority"]
    for year in range(1995, 2002):
        sk.store_batch(sk.quantile_states(orders.filter(F.col("year") == year), "o_totalprice", by), path, str(year))
    merged = sk.merged_quantiles(sk.stored_states(spark, path), by)
    found = sk.quantiles_of(merged, [0.25, 0.5, 0.75], by)
    ranks = orders.join(F.broadcast(found), by).groupBy(*by, "p").agg(
        F.avg((F.col("o_totalprice") < F.col("quantile")).cast("int")).alias("below"), F.avg((F.col("o_totalprice") <= F.col("quantile")).cast("int")).alias("upto"))
    error = 2 * sk.rank_error()
    kept = ranks.groupBy(*by).agg(F.bool_and((F.col("below") - error <= F.col("p")) & (F.col("p") <= F.col("upto") + error)).alias("within"))
    return merged.join(kept, by).select(*by, "total", "missing", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "within")


@query
def growing_duplicates(spark, d):
    """Customers per year of orders, stored as states: repeated ones over all years, and those new in each year."""
    orders = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").cast("string").alias("customer"))
    path, out = f"{scratch(spark)}/states", None
    for year in range(1995, 2002):
        sk.store_batch(sk.distinct_states(orders.filter(F.col("year") == year), "customer", lg=20), path, str(year))
    stored = sk.stored_states(spark, path)
    for year in range(1995, 2002):
        own, old = (sk.merged_distinct(stored.filter(c), lg=20) for c in (F.col("batch") == str(year), F.col("batch") < str(year)))
        row = sk.unseen_of(own, old).select(F.lit(str(year)).alias("batch"), F.col("distinct").alias("distinct_values"), "unseen")
        out = row if out is None else out.unionByName(row)
    whole = sk.duplicates_of(sk.merged_distinct(stored, lg=20)).select(F.lit("all").alias("batch"), F.col("distinct").alias("distinct_values"), F.col("duplicates").alias("unseen"))
    return out.unionByName(whole)


@query
def median_lines(spark, d):
    return di.median(table(spark, d, "lineitem"), "l_extendedprice").withColumn("median", F.round("median", 4))


@query
def below_threshold(spark, d):
    out = su.below_threshold(_tagged(spark, d).filter(F.col("error_type").isNull() | (F.col("error_type") == "low_confidence")), THRESHOLD)
    return out.withColumns({"mean_confidence": F.round("mean_confidence", 6), "below_share": F.round("below_share", 6)})


@query
def stage_counts(spark, d):
    raw = view(spark, d, "listings").select("listing_id", "raw_description")
    done = _normalized(spark, d)
    return su.stage_counts(raw, done.preprocessed, done.tagged)


@query
def analytics_job(spark, d):
    """All chart tables of one run, as (chart, label, measure, value) rows."""
    done = _normalized(spark, d)
    raw = view(spark, d, "listings").select("raw_description")
    charts = analytics(done.tagged, done.clean, raw, preprocessed=done.preprocessed)
    labels = {"category_counts": "category", "availability_counts": "availability", "error_counts": "error_type", "top_brands": "brand",
              "success_failure": "outcome", "histogram_price": "bin", "histogram_confidence": "bin", "histogram_length": "bin",
              "box_stats": "category", "enum_conformance": "field", "stage_counts": "stage"}
    out = None
    for name, chart in charts.items():
        label = labels.get(name)
        measures = [c for c in chart.columns if c != label]
        pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in measures])
        rows = chart.select(F.lit(name).alias("chart"), (F.col(label).cast("string") if label else F.lit("all")).alias("label"), F.inline(pairs))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def minimum_slice(spark, d):
    """Clean listings per category, from raw attempts."""
    return su.value_counts(ca.normalize_category(va.split(_tagged(spark, d))[0]), "category")
