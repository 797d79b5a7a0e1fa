"""DuckDB statements for the registered queries, written apart from the Spark expressions."""

from __future__ import annotations

from checks.queries import SHORT_TEMPLATE
from checks.views import ctes
from tidyshelf import lexicon as lx

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ORACLE: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def title(x: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all({x}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+'), "
            "lambda r: upper(r[1]) || lower(r[2:])), '')")


def spaced(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def no_controls(x: str) -> str:
    return rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"


def no_bullets(x: str) -> str:
    return f"regexp_replace({x}, '[{lx.BULLETS}]', chr(10), 'g')"


def no_glyphs(x: str) -> str:
    return (f"replace(regexp_replace(regexp_replace(regexp_replace({x}, '[‘’]', chr(39), 'g'), '[“”]', '\"', 'g'), "
            "'[–—]', '-', 'g'), '…', '...')")


def unescape(x: str) -> str:
    """Only the entities that occur in the inputs; the ampersand last, so nothing decodes twice."""
    out = x
    for entity, char in (("&middot;", "'·'"), ("&copy;", "'©'"), ("&quot;", "'\"'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        out = f"replace({out}, '{entity}', {char})"
    return out


def no_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def unmojibake(x: str) -> str:
    hexed = f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: printf('%02x', unicode(c))), '')"
    return f"CASE WHEN regexp_matches({x}, '[^\\x{{00}}-\\x{{ff}}]') THEN {x} ELSE coalesce(try(decode(unhex({hexed}))), {x}) END"


def cleaned(x: str) -> str:
    return spaced(no_glyphs(no_bullets(no_controls(f"nfc_normalize({no_tags(unescape(x))})"))))


def add(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ---- text ------------------------------------------------------------------------------------
D, M, L = ctes("dirty"), ctes("mojibake"), ctes("listings")
add("fix_encoding", f"{M} SELECT doc_id, {unmojibake('garbled')} AS fixed FROM mojibake")
add("nfc", f"{D} SELECT doc_id, nfc_normalize(dirty) AS composed FROM dirty")
add("control_chars", f"{D} SELECT doc_id, {no_controls('dirty')} AS kept FROM dirty")
add("bullets", f"{D} SELECT doc_id, {no_bullets('dirty')} AS lines FROM dirty")
add("punctuation", f"{D} SELECT doc_id, {no_glyphs('dirty')} AS plain FROM dirty")
add("whitespace", f"{D} SELECT doc_id, {spaced('dirty')} AS spaced FROM dirty")
add("sanitize_text", f"{D} SELECT doc_id, {strip(f'''regexp_replace(dirty, '{WS}+', ' ', 'g')''')} AS sane FROM dirty")
add("remove_html", f"SELECT page_id, {no_tags(unescape('html'))} AS plain FROM pages")
add("clean_description", f"{D} SELECT doc_id, {cleaned('dirty')} AS cleaned FROM dirty")
add("clean_pages", f"SELECT page_id, {cleaned('html')} AS cleaned FROM pages")
_joined = "concat_ws(' ', brand_txt, category_txt, avail_txt)"
add("py_title", f"{L} SELECT listing_id, {title(_joined)} AS titled FROM listings")
add("format_price", f"""{L} SELECT listing_id, CASE WHEN listing_id % 5 = 0 THEN 'N/A' ELSE
 CASE listing_id % 4 WHEN 0 THEN '₹' WHEN 1 THEN '$' WHEN 2 THEN '€' ELSE 'GBP' END || format('{{:,}}', price_int * 1234) END AS shown FROM listings""")
add("text_length", "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars FROM conversations")

# ---- sources, columns, filters ---------------------------------------------------------------
A = ctes("attempts")
add("pick_column", "SELECT doc_id, lang, text AS raw_description, source FROM documents")
add("pick_first_column", "SELECT s_name AS raw_description, s_suppkey FROM supplier")
add("fill_missing", f"""{A} SELECT listing_id, attempt, coalesce(raw_output, '') AS raw_output,
 CASE WHEN attempt = 3 THEN 'kept' ELSE '' END AS note FROM attempts""")
add("csv_round_trip", f"""{L} SELECT CAST(listing_id AS VARCHAR) AS id, brand_txt AS brand, '' AS offer,
 ' say "hi",' || chr(10) || raw_description || '  ' AS raw_description FROM listings""")
add("errors_round_trip", f"""{A} SELECT CAST(listing_id AS VARCHAR) AS id, '' AS raw_description, '' AS error_type, '' AS error_detail,
 CAST(attempt AS VARCHAR) AS retry_count, coalesce(raw_output, '') AS llm_raw_output FROM attempts""")
add("jsonl_round_trip", f"""{A} SELECT coalesce(raw_output, '') AS z_text, CAST(listing_id AS VARCHAR) AS listing_id,
 CAST(attempt AS VARCHAR) AS attempt FROM attempts""")
add("jsonl_repeated_runs", f"""{A} SELECT listing_id, attempt, raw_output, CASE WHEN attempt = 1 THEN 'first' ELSE 'others' END AS run FROM attempts""")
add("detect_columns", """WITH n AS (SELECT count(*) AS rows_seen FROM customer),
 seen AS (SELECT bool_or(trim(c_name) <> '') AS a, bool_or(c_custkey IS NOT NULL) AS b, bool_or(trim(c_mktsegment) <> '') AS c FROM customer)
 SELECT rows_seen, ord, column_name FROM n, (SELECT 0 AS ord, 'c_name' AS column_name FROM seen WHERE a
 UNION ALL SELECT 1, 'c_custkey' FROM seen WHERE b UNION ALL SELECT 2, 'c_mktsegment' FROM seen WHERE c)""")
_seg = "CASE WHEN c_custkey % 4 >= 2 THEN c_mktsegment END"
add("build_description", f"""SELECT c_custkey, concat_ws(chr(10), 'Market Segment2B: ' || {_seg}, 'C Name: ' || c_name,
 'Home Nation: ' || c_nationkey) AS raw_description FROM customer""")
add("build_description_plain", f"SELECT c_custkey, concat_ws(chr(10), c_name, {_seg}) AS raw_description FROM customer")
add("resolve_columns", "SELECT c_name, c_custkey FROM customer")
add("drop_empty", "SELECT conv_id, turn, text AS raw_description FROM conversations WHERE trim(text) <> ''")
_null = "CAST(NULL AS VARCHAR)"
add("conform_clean", f"""{L} SELECT listing_id AS id, {_null} AS product_name, brand_txt AS brand, {_null} AS category, price_int AS price,
 {_null} AS currency, {_null} AS offer, {_null} AS availability, {_null} AS delivery, {_null} AS seller, CAST(NULL AS DOUBLE) AS confidence,
 {_null} AS processing_status, raw_description FROM listings""")
add("conform_errors", f"""{A} SELECT listing_id AS id, {_null} AS raw_description, {_null} AS error_type, {_null} AS error_detail,
 attempt AS retry_count, raw_output AS llm_raw_output FROM attempts""")
add("to_raw", "SELECT doc_id AS id, text AS raw_description FROM documents")
add("filter_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS confidence FROM lineitem WHERE NOT l_discount < 0.05")
add("numeric_price", f"{L} SELECT listing_id, CAST(price_int AS VARCHAR) AS price FROM listings")

# ---- order, duplicates, top-k ----------------------------------------------------------------
add("assign_ids", "SELECT row_number() OVER (ORDER BY lang, source, doc_id) AS id, doc_id, lang, source FROM documents")
add("assign_ids_orders", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id, o_totalprice, o_orderkey FROM orders")
add("dedup_exact", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
add("dedup_rows", """SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, lower(text) AS text,
 row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1""")
add("dedup_hot_rows", """SELECT flags, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM (SELECT *, l_returnflag || '/' || l_linestatus AS flags,
 row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r FROM lineitem) WHERE r = 1""")
add("head_after_dedup", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text ORDER BY 1 LIMIT 100")
add("preview", """SELECT c_custkey, 'C Name: ' || c_name || chr(10) || 'C Mktsegment: ' || c_mktsegment AS raw_description
 FROM customer ORDER BY c_custkey LIMIT 10""")
add("top_suppliers", "SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, l_suppkey LIMIT 15")
_first = "SELECT {k}, c AS raw_description, row_number() OVER (ORDER BY {k}) AS id FROM (SELECT {k}, c, row_number() OVER (PARTITION BY c ORDER BY {k}) AS r FROM {t}) WHERE r = 1"
add("preprocess_job", f"{D}, u AS (SELECT doc_id, {unmojibake('dirty')} AS f FROM dirty WHERE {strip('dirty')} <> ''), t AS (SELECT doc_id, {cleaned('f')} AS c FROM u) {_first.format(k='doc_id', t='t')}")
add("preprocess_chats", f"""WITH s AS (SELECT conv_id, turn, text AS x FROM conversations UNION ALL SELECT conv_id, turn - 1, '<br>' FROM conversations WHERE turn = 0),
 u AS (SELECT conv_id, turn, {unmojibake('x')} AS f FROM s WHERE {strip('x')} <> ''), t AS (SELECT conv_id, turn, {cleaned('f')} AS c FROM u)
 {_first.format(k='conv_id, turn', t='t')}""")


# ---- JSON and prices -------------------------------------------------------------------------
def objects(source: str, out: str, id_col: str = "listing_id", extra: str = "") -> str:
    """CTEs that find the JSON object (``doc``) in ``raw_output``."""
    return f"""{out}_a AS (SELECT {id_col} AS id, {extra} raw_output, {strip("regexp_extract(raw_output, '(?is)```(?:json)?[ \\t\\r\\n]*(.*?)```', 1)")} AS f,
  regexp_extract(raw_output, '(?s)\\{{.*\\}}') AS b, {strip('raw_output')} AS w FROM {source}),
 {out} AS (SELECT id, {extra} raw_output, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS doc FROM (SELECT *,
  CASE WHEN f <> '' AND json_valid(f) THEN f WHEN b <> '' AND json_valid(b) THEN b WHEN json_valid(w) THEN w END AS j FROM {out}_a))"""


def pattern(p: str) -> str:
    inner = WS[1:-1]
    out, in_class = "", False
    i = 0
    while i < len(p):
        two = p[i:i + 2]
        if two == r"\s":
            out += inner if in_class else WS
            i += 2
            continue
        if two == r"\d":
            out += "0-9" if in_class else "[0-9]"
            i += 2
            continue
        in_class = (p[i] == "[") or (in_class and p[i] != "]")
        out += p[i]
        i += 1
    return lit(out)


def amounts(x: str, patterns: list[str]) -> str:
    lists = ", ".join(f"coalesce(regexp_extract_all({x}, {pattern(p)}, 1), [])" for p in patterns)
    flat = f"flatten([{lists}])"
    return f"list_transform({flat}, lambda a: TRY_CAST(replace(a, ',', '') AS BIGINT))"


def price_in(x: str) -> str:
    return (f"list_filter({amounts(x, lx.PRICE_PATTERNS)}, lambda v: v > 0 AND NOT "
            f"coalesce(list_contains({amounts(x, lx.DISCOUNT_PATTERNS)}, v), false))[1]")


add("extract_json", f"""{A}, {objects('attempts', 'o', extra='attempt,')} SELECT id AS listing_id, attempt, doc IS NOT NULL AS is_object, doc->>'$.brand' AS brand FROM o""")
O = ctes("odd_replies")
add("extract_json_odd", f"{O}, {objects('odd_replies', 'o')} SELECT id AS listing_id, doc IS NOT NULL AS is_object, doc->>'$.category' AS category FROM o")
add("strict_json", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k FROM events")
_kinds = ", ".join(
    f"CASE coalesce(json_type(doc, '$.{n}'), 'ABSENT') WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'BIGINT' THEN 'NUMBER' WHEN 'DOUBLE' THEN 'NUMBER' ELSE coalesce(json_type(doc, '$.{n}'), 'ABSENT') END AS {n}"
    for n in ("product_name", "brand", "category", "price", "currency", "offer", "seller", "confidence"))
add("json_kinds", f"{O}, {objects('odd_replies', 'o')} SELECT id AS listing_id, {_kinds} FROM o WHERE doc IS NOT NULL")
P = ctes("price_texts")
add("extract_price", f"{P} SELECT listing_id, {price_in('txt')} AS price FROM price_texts")
add("extract_price_listings", f"{L} SELECT listing_id, {price_in('raw_description')} AS price FROM listings")
add("discount_amounts", f"{P} SELECT listing_id, unnest(list_distinct({amounts('txt', lx.DISCOUNT_PATTERNS)})) AS amount FROM price_texts")
add("fill_price", f"""{L} SELECT listing_id, CASE WHEN listing_id % 2 = 0 THEN CAST(price_int AS VARCHAR)
 ELSE CAST({price_in('raw_description')} AS VARCHAR) END AS price FROM listings""")

# ---- prompts and replies ---------------------------------------------------------------------
_before, _after = SHORT_TEMPLATE.split("{raw_description}")
add("build_prompts", f"{L} SELECT listing_id, {lit(_before)} || raw_description || {lit(_after)} AS prompt FROM listings")


def resolved(source: str, limit: int, name: str = "res") -> str:
    return f"""{objects(source, name + '_o', extra='attempt,')},
 {name} AS (SELECT id, arg_min(doc, attempt) FILTER (doc IS NOT NULL) AS doc,
  CAST(coalesce(min(attempt) FILTER (doc IS NOT NULL) - 1, {limit}) AS INTEGER) AS retry_count,
  coalesce(arg_min(raw_output, attempt) FILTER (doc IS NOT NULL), arg_max(raw_output, attempt) FILTER (raw_output IS NOT NULL)) AS llm_raw_output
  FROM {name}_o WHERE attempt <= {limit} GROUP BY id)"""


add("resolve_attempts", f"{A}, {resolved('attempts', 3)} SELECT id, doc IS NOT NULL AS answered, retry_count, llm_raw_output, doc->>'$.brand' AS brand FROM res")
add("resolve_two_attempts", f"{A}, {resolved('attempts', 2)} SELECT id, doc IS NOT NULL AS answered, retry_count, llm_raw_output FROM res")


def echoed(source: str, id_col: str, text: str) -> str:
    """The stand-in extractor as a table of attempts."""
    brand = f"(['apple', 'one plus', 'H&M', 'acme'])[1 + {id_col} % 4]"
    category = f"(['tv', 'Gaming Laptop', 'wireless headphones', 'garden tools', 'smartphone'])[1 + {id_col} % 7 % 5]"
    reply = f"""CASE WHEN {id_col} % 5 = 0 THEN 'no idea' ELSE '{{"product_name": ' || CAST(to_json({text}) AS VARCHAR)
  || ', "brand": "' || {brand} || '", "category": "' || {category} || '", "confidence": 0.9}}' END"""
    return f"""SELECT {id_col} AS id, CAST(1 AS INTEGER) AS attempt, CASE WHEN {id_col} % 3 <> 0 THEN {reply} END AS raw_output FROM {source}
 UNION ALL SELECT {id_col}, CAST(2 AS INTEGER), {reply} FROM {source} WHERE {id_col} % 3 = 0 OR {id_col} % 5 = 0
 UNION ALL SELECT {id_col}, CAST(3 AS INTEGER), {reply} FROM {source} WHERE {id_col} % 5 = 0"""


add("apply_extractor", f"{L} {echoed('listings', 'listing_id', 'raw_description')}")

add("extractor_ledger", f"{L} {echoed('(SELECT listing_id, CAST(listing_id AS VARCHAR) || chr(32) || raw_description AS d FROM listings)', 'listing_id', 'd')}")

# ---- validation ------------------------------------------------------------------------------
def answered(tried: str) -> str:
    return f"""{A}, tried AS ({tried}), {resolved('tried', 3)},
 answered AS (SELECT l.listing_id AS id, l.raw_description, res.doc, coalesce(res.retry_count, 0) AS retry_count, res.llm_raw_output
  FROM listings l LEFT JOIN res ON res.id = l.listing_id)"""


ANSWERED = answered("SELECT * FROM attempts")
ODD = f"""{ctes('listings', 'odd_replies')}, {objects('odd_replies', 'o')}, answered AS (SELECT id, l.raw_description, doc, 0 AS retry_count, raw_output AS llm_raw_output
 FROM o JOIN listings l ON l.listing_id = o.id)"""
NUMS = "('BIGINT', 'UBIGINT', 'DOUBLE')"
FIELDS = ["product_name", "brand", "category", "price", "currency", "offer", "availability", "delivery", "seller", "confidence"]


def fields(strict: bool = False) -> str:
    """CTEs from ``answered`` to ``typed`` (coerced fields) and ``broken`` (violations)."""
    raw = ", ".join(f"coalesce(json_type(doc, '$.{n}'), 'ABSENT') AS k_{n}, doc->>'$.{n}' AS t_{n}" for n in FIELDS)

    def text(n: str) -> str:
        return f"""CASE WHEN k_{n} = 'VARCHAR' THEN {strip(f't_{n}')} WHEN k_{n} IN {NUMS} AND CAST(t_{n} AS DOUBLE) <> 0 THEN t_{n}
  WHEN k_{n} = 'BOOLEAN' AND t_{n} = 'true' THEN 'True' WHEN k_{n} IN ('ARRAY', 'OBJECT') AND t_{n} NOT IN ('[]', '{{}}') THEN t_{n} END AS {n}"""

    dot = "₹|Rs|INR" if strict else r"₹|Rs\.?|INR"
    bare = strip(f"replace(regexp_replace(t_price, '{dot}', '', 'g'), ',', '')")
    number = r"^[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
    price = f"""coalesce(CASE WHEN k_price IN {NUMS} THEN TRY_CAST(trunc(CAST(t_price AS DOUBLE)) AS BIGINT) WHEN k_price = 'BOOLEAN' THEN CAST(t_price = 'true' AS BIGINT)
  WHEN k_price = 'VARCHAR' AND regexp_matches({bare}, '{number}', 'i') THEN TRY_CAST(trunc(TRY_CAST(replace({bare}, '_', '') AS DOUBLE)) AS BIGINT) END,
  CASE WHEN doc IS NOT NULL AND k_price IN ('ABSENT', 'NULL') THEN {price_in('raw_description')} END) AS price"""
    money = " ".join(f"WHEN {lit(k)} THEN '{v}'" for k, v in lx.CURRENCY_CODES.items())
    currency = f"coalesce(CASE lower({strip('t_currency')}) {money} END, 'INR') AS currency"
    optional = ", ".join(f"CASE WHEN k_{n} = 'VARCHAR' THEN t_{n} END AS {n}" for n in ("offer", "delivery", "seller"))
    stock = "CASE k_availability WHEN 'ABSENT' THEN 'Unknown' WHEN 'VARCHAR' THEN t_availability END AS availability"
    conf = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN k_confidence IN {NUMS} THEN CAST(t_confidence AS DOUBLE) WHEN k_confidence = 'BOOLEAN' THEN CAST(t_confidence = 'true' AS DOUBLE)
  WHEN t_confidence = 'nan' THEN 1.0 WHEN k_confidence = 'VARCHAR' THEN TRY_CAST(t_confidence AS DOUBLE) END, 0.0))) AS confidence"""
    rules = []
    for n, least in (("product_name", 2), ("brand", 1), ("category", 0)):
        rules += [(n, "missing", f"k_{n} = 'ABSENT'", "Field required"),
                  (n, "string_type", f"k_{n} <> 'ABSENT' AND {n} IS NULL", "Input should be a valid string"),
                  (n, "string_too_short", f"length({n}) < {least}", f"String should have at least {least} character{'s' if least > 1 else ''}")]
    rules += [("price", "greater_than_equal", "price < 0", "Input should be greater than or equal to 0"),
              ("availability", "string_type", "k_availability NOT IN ('ABSENT', 'VARCHAR')", "Input should be a valid string"),
              ("confidence", "missing", "k_confidence = 'ABSENT'", "Field required")]
    rules += [(n, "string_type", f"k_{n} NOT IN ('ABSENT', 'NULL', 'VARCHAR')", "Input should be a valid string") for n in ("offer", "delivery", "seller")]
    broken = " UNION ALL ".join(
        f"SELECT id, {i} AS place, '{f}' AS field, '{t}' AS type, '{m}' AS msg FROM typed WHERE doc IS NOT NULL AND {c}"
        for i, (f, t, c, m) in enumerate(sorted(rules, key=lambda r: FIELDS.index(r[0]))))
    return f"""kinds AS (SELECT *, {raw} FROM answered),
 typed AS (SELECT id, raw_description, doc, retry_count, llm_raw_output, {', '.join(f'k_{n}' for n in FIELDS)},
  {text('product_name')}, {text('brand')}, {text('category')}, {price}, {currency}, {optional}, {stock}, {conf} FROM kinds),
 broken AS ({broken})"""


def routed(threshold: float) -> str:
    return f"""tagged AS (SELECT *, CASE WHEN doc IS NULL THEN 'json_parse_error' WHEN id IN (SELECT id FROM broken) THEN 'validation_error'
  WHEN confidence < {threshold} THEN 'low_confidence' END AS error_type FROM typed)"""


TAGGED = f"{ANSWERED}, {fields()}, {routed(0.5)}"
ODD_TAGGED = f"{ODD}, {fields()}, {routed(0.4)}"
add("join_replies", f"{answered('SELECT * FROM attempts WHERE listing_id % 17 <> 0')} SELECT id, raw_description, doc IS NOT NULL AS answered, retry_count, llm_raw_output FROM answered")
add("coerce_price", f"{ODD}, {fields()} SELECT id, price FROM typed WHERE doc IS NOT NULL")
add("coerce_price_strict", f"{ODD}, {fields(True)} SELECT id, price FROM typed WHERE doc IS NOT NULL")
add("currency", f"{ODD}, {fields()} SELECT id, currency FROM typed WHERE doc IS NOT NULL")
add("confidence", f"{ODD}, {fields()} SELECT id, confidence FROM typed WHERE doc IS NOT NULL")
add("stripped_fields", f"{ODD}, {fields()} SELECT id, product_name, brand, category FROM typed WHERE doc IS NOT NULL")
add("optional_fields", f"{ODD}, {fields()} SELECT id, offer, seller, delivery, availability FROM typed WHERE doc IS NOT NULL")
add("violations", f"{ODD}, {fields()} SELECT id, field, type, msg FROM broken")
add("violations_replies", f"{ANSWERED}, {fields()} SELECT id, field, type, msg FROM broken")
add("validate_route", f"{TAGGED} SELECT id, error_type, CASE WHEN error_type IS NULL THEN 'success' END AS processing_status FROM tagged")
add("validate_route_odd", f"{ODD_TAGGED} SELECT id, error_type FROM tagged")


def detail(threshold: float) -> str:
    return f"""CASE error_type WHEN 'json_parse_error' THEN 'The extractor returned no valid JSON after all retries'
  WHEN 'validation_error' THEN (SELECT '[' || string_agg('{{"field":"' || field || '","type":"' || type || '","msg":"' || msg || '"}}', ',' ORDER BY place) || ']' FROM broken WHERE broken.id = tagged.id)
  WHEN 'low_confidence' THEN 'Confidence ' || format('{{:.2f}}', confidence) || ' < threshold {threshold:.2f}' END AS error_detail"""


_WANTED = "error_type IS NOT NULL"
add("error_detail", f"""SELECT id, error_type, error_detail FROM ({ODD_TAGGED} SELECT id, error_type, {detail(0.4)} FROM tagged WHERE {_WANTED})
 UNION ALL SELECT id, error_type, error_detail FROM ({TAGGED} SELECT id, error_type, {detail(0.5)} FROM tagged WHERE {_WANTED})""")
PRODUCT = ", ".join(FIELDS)
add("split_clean", f"{TAGGED} SELECT id, {PRODUCT}, 'success' AS processing_status, raw_description FROM tagged WHERE error_type IS NULL")
add("split_errors", f"{TAGGED} SELECT id, raw_description, error_type, {detail(0.5)}, retry_count, llm_raw_output FROM tagged WHERE error_type IS NOT NULL")
_share = " UNION ALL ".join(
    f"SELECT '{n}' AS field, round(avg(CAST({n} IN ({', '.join(map(lit, v))}) AS INTEGER)), 6) AS share FROM tagged WHERE error_type IS NULL"
    for n, v in lx.DECLARED_VALUES.items())
add("enum_conformance", f"{TAGGED} {_share}")


# ---- canonical values ------------------------------------------------------------------------
def alias_cte(name: str, dim: dict[str, str]) -> str:
    rows = ", ".join(f"({i}, {lit(a)}, {lit(c)})" for i, (a, c) in enumerate(dim.items()))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS v(ord, alias, canonical))"


DIMS = ", ".join([alias_cte("bd", lx.BRAND_ALIASES), alias_cte("cd", lx.CATEGORY_ALIASES), alias_cte("ad", lx.AVAILABILITY_ALIASES)])


def brand_of(x: str) -> str:
    return f"coalesce((SELECT canonical FROM bd WHERE alias = lower({strip(x)})), {title(strip(x))})"


def category_of(x: str) -> str:
    return (f"coalesce((SELECT canonical FROM cd WHERE alias = lower({strip(x)})), "
            f"(SELECT arg_min(canonical, ord) FROM cd WHERE contains(lower({strip(x)}), alias)), {title(strip(x))})")


def stock_of(x: str) -> str:
    return (f"coalesce((SELECT canonical FROM ad WHERE alias = lower({strip(x)})), "
            f"CASE WHEN regexp_matches(lower({strip(x)}), '^only [0-9]+ left') THEN 'Limited Stock' END, {strip(x)})")


add("brand", f"{L}, {DIMS} SELECT listing_id, {brand_of('brand_txt')} AS brand FROM listings")
add("category", f"{L}, {DIMS} SELECT listing_id, {category_of('category_txt')} AS category FROM listings")
add("category_by_join", ORACLE["category"])
add("category_many_aliases", """WITH d AS (SELECT lower(p_name) AS alias, min(p_partkey) AS p FROM part GROUP BY 1)
 SELECT p_partkey, 'P' || (SELECT min(p) FROM d WHERE contains('the ' || lower(p_name) || ' x', alias)) AS category FROM part""")
add("brand_many_aliases", "SELECT p_partkey, 'B' || p_partkey AS brand FROM part")
add("json_column_order", "SELECT p_partkey, p_name AS title, CAST(9 * 9 + 61 * 10 + 71 AS BIGINT) AS specs_length, 'specs,title,aaa' AS names FROM part")
add("availability", f"{L}, {DIMS} SELECT listing_id, {stock_of('avail_txt')} AS availability FROM listings")
add("offer", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 2 THEN '10% off ' || s_name END AS offer FROM supplier")
add("seller", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 2 THEN 'O''Neil & Sons ' || s_name END AS seller FROM supplier""")
add("currency_case", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'USD' ELSE 'INR' END AS currency FROM customer")
CANON = f"""clean AS (SELECT id, product_name, {brand_of('brand')} AS brand, {category_of('category')} AS category, price, upper(currency) AS currency,
  nullif({strip(f"regexp_replace(offer, '{WS}+', ' ', 'g')")}, '') AS offer, {stock_of('availability')} AS availability, delivery,
  {title(strip("nullif(seller, '')"))} AS seller, confidence, 'success' AS processing_status, raw_description FROM tagged WHERE error_type IS NULL)"""
CLEAN = f"{TAGGED}, {DIMS}, {CANON}"
add("postprocess_job", f"{CLEAN} SELECT * FROM clean")


# ---- whole jobs ------------------------------------------------------------------------------
def job(merged: str, replies: str, key: str = "listing_id") -> str:
    """CTEs from a table ``m(listing_id, x)`` of merged texts to ``clean`` and ``tagged``."""
    return f"""m AS ({merged}), u AS (SELECT listing_id, {unmojibake('x')} AS f FROM m WHERE {strip('x')} <> ''),
 t AS (SELECT listing_id, {cleaned('f')} AS c FROM u), pre AS ({_first.format(k='listing_id', t='t')}),
 {replies}, answered AS (SELECT pre.id, pre.raw_description, res.doc, coalesce(res.retry_count, 0) AS retry_count, res.llm_raw_output
  FROM pre LEFT JOIN res ON res.id = pre.{key}), {fields()}, {routed(0.5)}, {DIMS}, {CANON}"""


_plain = "SELECT listing_id, raw_description AS x FROM listings"
JOB = f"{A}, {job(_plain, resolved('attempts', 3))}"
add("normalize_table_job", f"{JOB} SELECT * FROM clean")
add("normalize_table_errors", f"{JOB} SELECT id, raw_description, error_type, {detail(0.5)}, retry_count, llm_raw_output FROM tagged WHERE error_type IS NOT NULL")
_labeled = "SELECT listing_id, 'Title: ' || raw_description || chr(10) || 'Kind: ' || category_txt AS x FROM listings"
add("normalize_merged_job", f"{A}, {job(_labeled, resolved('attempts', 3))} SELECT id, raw_description, brand, price FROM clean")
_echo = f"echo AS ({echoed('pre', 'id', 'raw_description')}), {resolved('echo', 3)}".replace("listing_id AS id, attempt, raw_output, regexp", "id, attempt, raw_output, regexp")
_echo_job = f"{L}, {job(_plain, _echo.replace('SELECT listing_id AS id, attempt, raw_output', 'SELECT id, attempt, raw_output'), 'id')}"
SUMMARY = """SELECT count(*) AS total, count(*) FILTER (error_type IS NULL) AS success, count(*) FILTER (error_type IS NOT NULL) AS errors,
 round(100.0 * count(*) FILTER (error_type IS NULL) / count(*), 2) AS success_rate FROM tagged"""
add("listing_files_job", f"{_echo_job} {SUMMARY}")
add("listing_files_clean", f"{_echo_job} SELECT * FROM clean")

# ---- analytics -------------------------------------------------------------------------------
add("run_summary", f"{TAGGED} {SUMMARY}")
add("avg_confidence", f"{CLEAN} SELECT round(coalesce(avg(confidence), 0), 6) AS avg_confidence FROM clean")
add("published_results", f"""{TAGGED} SELECT id, raw_description, CASE WHEN error_type IS NULL THEN 'clean' ELSE 'errors' END AS table_name FROM tagged""")
add("growing_quantiles", """SELECT o_orderpriority, count(*) AS total, CAST(0 AS BIGINT) AS missing, CAST(min(o_totalprice) AS DOUBLE) AS low,
 CAST(max(o_totalprice) AS DOUBLE) AS high, true AS within FROM orders GROUP BY 1""")
add("growing_duplicates", """WITH o AS (SELECT year(o_orderdate) AS y, o_custkey AS c FROM orders), firsts AS (SELECT c, min(y) AS f FROM o GROUP BY 1),
 years AS (SELECT CAST(range AS BIGINT) AS y FROM range(1995, 2002))
 SELECT CAST(y AS VARCHAR) AS batch, (SELECT count(DISTINCT c) FROM o WHERE o.y = years.y) AS distinct_values,
 (SELECT count(*) FROM firsts WHERE f = years.y) AS unseen FROM years
 UNION ALL SELECT 'all', count(DISTINCT c), count(*) - count(DISTINCT c) FROM o""")
add("category_counts", f"{CLEAN} SELECT category, count(*) AS count FROM clean GROUP BY 1")
add("segment_counts", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
add("availability_counts", f"{CLEAN} SELECT availability, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM clean GROUP BY 1")
add("error_counts", f"{TAGGED} SELECT error_type, count(*) AS count FROM tagged WHERE error_type IS NOT NULL GROUP BY 1")
add("top_brands", f"{CLEAN} SELECT brand, count(*) AS count FROM clean GROUP BY 1 ORDER BY count DESC, brand LIMIT 15")
add("success_failure", f"""{TAGGED} SELECT CASE WHEN error_type IS NULL THEN 'Success' ELSE 'Failed' END AS outcome, count(*) AS count,
 round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM tagged GROUP BY 1""")


def hist(with_: str, source: str, x: str, bins: int) -> str:
    return f"""{with_} v AS (SELECT CAST({x} AS DOUBLE) AS x FROM {source} WHERE {x} IS NOT NULL), b AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
 g AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / {bins}) AS low, lo + (i + 1) * ((hi - lo) / {bins}) AS high FROM b, range({bins}) r(i))
 SELECT bin, round(low, 6) AS low, round(high, 6) AS high, count(x) AS count FROM g LEFT JOIN v
 ON x >= low AND (x < high OR bin = {bins} - 1) GROUP BY ALL"""


add("histogram_price", hist(f"{CLEAN},", "clean", "price", 30))
add("histogram_confidence", hist(f"{CLEAN},", "clean", "confidence", 20))
add("histogram_length", hist("WITH", "documents", "length(text)", 40))
add("histogram_orders", hist("WITH", "orders", "o_totalprice", 30))


def described(x: str, source: str) -> str:
    return f"""SELECT count({x}) AS count, round(avg({x}), 1) AS mean, round(stddev_samp({x}), 1) AS std, CAST(min({x}) AS DOUBLE) AS min,
 round(quantile_cont({x}, 0.25), 1) AS q1, round(quantile_cont({x}, 0.5), 1) AS median, round(quantile_cont({x}, 0.75), 1) AS q3,
 CAST(max({x}) AS DOUBLE) AS max FROM {source}"""


add("describe_length", described("length(text)", "documents"))
add("describe_orders", described("o_totalprice", "orders"))
add("duplicates", """WITH c AS (SELECT text AS t FROM conversations UNION ALL SELECT NULL FROM conversations WHERE turn % 9 = 8)
 SELECT count(*) AS total, count(*) FILTER (t IS NULL) AS missing,
 count(*) - count(DISTINCT t) - CAST(bool_or(t IS NULL) AS INTEGER) AS duplicates FROM c""")


def boxes(with_: str, source: str, group: str, value: str, k: int) -> str:
    return f"""{with_} top AS (SELECT {group} FROM {source} GROUP BY 1 ORDER BY count(*) DESC, {group} LIMIT {k}),
 kept AS (SELECT {group}, {value} AS v FROM {source} WHERE {group} IN (SELECT {group} FROM top) AND {value} IS NOT NULL),
 q AS (SELECT {group}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM kept GROUP BY 1),
 f AS (SELECT kept.*, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM kept JOIN q USING ({group}))"""


def box_table(group: str) -> str:
    return f"""SELECT {group}, count(*) AS count, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
 least(CAST(min(v) FILTER (v >= lo) AS DOUBLE), q1) AS whisker_low, greatest(CAST(max(v) FILTER (v <= hi) AS DOUBLE), q3) AS whisker_high,
 count(*) FILTER (v < lo OR v > hi) AS outliers FROM f GROUP BY {group}, q1, median, q3"""


add("box_stats", f"{boxes(CLEAN + ',', 'clean', 'category', 'price', 8)} {box_table('category')}")
add("box_stats_lines", f"{boxes('WITH', 'lineitem', 'l_returnflag', 'l_extendedprice', 8)} {box_table('l_returnflag')}")
add("box_outliers", f"""{boxes('WITH s AS (SELECT o_orderpriority, round(pow(o_totalprice / 100000, 4), 2) AS skewed FROM orders),', 's', 'o_orderpriority', 'skewed', 3)}
 SELECT o_orderpriority, v AS skewed, count(*) AS n FROM f WHERE v < lo OR v > hi GROUP BY 1, 2""")
add("median_price", f"{CLEAN} SELECT CAST(median(price) AS DOUBLE) AS median FROM clean")
add("median_lines", "SELECT round(median(l_extendedprice), 4) AS median FROM lineitem")
add("below_threshold", f"""{TAGGED} SELECT round(avg(confidence), 6) AS mean_confidence, CAST(0.5 AS DOUBLE) AS threshold, count(*) FILTER (confidence < 0.5) AS below,
 round(count(*) FILTER (confidence < 0.5) / count(*), 6) AS below_share FROM tagged WHERE error_type IS NULL OR error_type = 'low_confidence'""")
add("stage_counts", f"""{JOB} SELECT 1 AS position, 'raw' AS stage, count(*) AS rows FROM listings UNION ALL SELECT 2, 'preprocessed', count(*) FROM pre
 UNION ALL SELECT 3, 'clean', count(*) FROM tagged WHERE error_type IS NULL UNION ALL SELECT 4, 'errors', count(*) FROM tagged WHERE error_type IS NOT NULL""")


def long(chart: str, label: str, table_sql: str, *measures: str) -> str:
    """One chart as (chart, label, measure, value) rows."""
    return " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, CAST({label} AS VARCHAR) AS label, '{m}' AS measure, round(CAST({m} AS DOUBLE), 4) AS value FROM ({table_sql})" for m in measures)


def chart(name: str) -> str:
    """The statement of a chart's own query, over the CTEs of the job."""
    return ORACLE[name].replace(f"{CLEAN},", "WITH").replace(CLEAN, "").replace(TAGGED, "")


_BINS, _BOX = ("low", "high", "count"), ("count", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
_less = "SELECT avg(confidence) AS mean_confidence, 0.5 AS threshold, count(*) FILTER (confidence < 0.5) AS below, count(*) FILTER (confidence < 0.5) / count(*) AS below_share FROM clean"
add("analytics_job", f"{JOB} " + " UNION ALL ".join([
    long("run_summary", "'all'", SUMMARY, "total", "success", "errors", "success_rate"),
    long("avg_confidence", "'all'", "SELECT avg(confidence) AS avg_confidence FROM clean", "avg_confidence"),
    long("category_counts", "category", chart("category_counts"), "count"),
    long("availability_counts", "availability", chart("availability_counts"), "count", "percent"),
    long("error_counts", "error_type", chart("error_counts"), "count"),
    long("top_brands", "brand", chart("top_brands"), "count"),
    long("success_failure", "outcome", chart("success_failure"), "count", "percent"),
    long("histogram_price", "bin", chart("histogram_price"), *_BINS),
    long("histogram_confidence", "bin", chart("histogram_confidence"), *_BINS),
    long("box_stats", "category", chart("box_stats"), *_BOX),
    long("median_price", "'all'", chart("median_price"), "median"),
    long("below_threshold", "'all'", _less, "mean_confidence", "threshold", "below", "below_share"),
    long("enum_conformance", "field", chart("enum_conformance").replace("FROM tagged WHERE error_type IS NULL", "FROM clean"), "share"),
    long("histogram_length", "bin", hist("WITH", "listings", "length(raw_description)", 40), *_BINS),
    long("describe_length", "'all'", described("length(raw_description)", "listings"), "count", "mean", "std", "min", "q1", "median", "q3", "max"),
    long("duplicates", "'all'", "SELECT count(*) AS total, 0 AS missing, count(*) - count(DISTINCT raw_description) AS duplicates FROM listings", "total", "missing", "duplicates"),
    long("stage_counts", "stage", ORACLE["stage_counts"].replace(JOB, ""), "position", "rows"),
]))
add("minimum_slice", f"{TAGGED}, {DIMS} SELECT category, count(*) AS count FROM (SELECT {category_of('category')} AS category FROM tagged WHERE error_type IS NULL) GROUP BY 1")
add("normalize_one_text", f"""{A}, one AS (SELECT max(listing_id) AS k FROM listings), {resolved('attempts', 3)},
 mended AS (SELECT listing_id, {unmojibake('raw_description')} AS f FROM listings JOIN one ON listing_id = k),
 answered AS (SELECT listing_id AS id, {cleaned('f')} AS raw_description, res.doc, coalesce(res.retry_count, 0) AS retry_count, res.llm_raw_output
 FROM mended LEFT JOIN res ON res.id = listing_id), {fields()}, {routed(0.5)}
 SELECT id, raw_description, brand, price, error_type, retry_count FROM tagged""")
