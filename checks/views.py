"""Derived inputs, in SQL that Spark and DuckDB both run unchanged.

(Only the generator in ``attempts`` is spelled per engine.) They give the driver tables the shape of scraped listings and of replies, and put dirt into texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LISTINGS = """
SELECT p_partkey AS listing_id,
 CASE p_partkey % 10 WHEN 0 THEN 'apple' WHEN 1 THEN 'SAMSUNG' WHEN 2 THEN 'one plus' WHEN 3 THEN 'redmi' WHEN 4 THEN 'boAt'
   WHEN 5 THEN 'hewlett-packard' WHEN 6 THEN 'H&M' WHEN 7 THEN 'oxford' WHEN 8 THEN 'levis' ELSE lower(p_brand) END AS brand_txt,
 CASE p_partkey % 9 WHEN 0 THEN 'smartphone' WHEN 1 THEN 'Gaming Laptop' WHEN 2 THEN 'wireless headphones' WHEN 3 THEN 'OLED' WHEN 4 THEN 'running shoes'
   WHEN 5 THEN 'Tablet' WHEN 6 THEN 'air fryer' WHEN 7 THEN 'e-book reader' ELSE 'garden tools' END AS category_txt,
 CASE p_partkey % 7 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Only 2 Left!' WHEN 2 THEN 'sold out' WHEN 3 THEN 'Pre-order' WHEN 4 THEN 'Only 12 left' WHEN 5 THEN 'Ask seller' ELSE 'Hurry' END AS avail_txt,
 CAST(floor(p_retailprice) AS BIGINT) AS price_int,
 concat('<b>', p_name, '</b>',
  CASE p_partkey % 3 WHEN 0 THEN ' | ' WHEN 1 THEN '  •  ' ELSE ' &amp; ' END,
  CASE p_partkey % 6 WHEN 0 THEN 'Rs.' WHEN 1 THEN 'MRP: Rs.9999 Sale: ' WHEN 2 THEN '₹' WHEN 3 THEN 'INR ' WHEN 4 THEN 'Price: ' ELSE 'Flat Rs.500 OFF ' END,
  CASE WHEN p_partkey % 6 = 5 THEN '' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) END,
  ' – Ships “Tomorrow”…') AS raw_description
FROM part
"""

# THREE stands for each engine's way to repeat a row for attempts 1 to 3.
ATTEMPTS = """
SELECT l.listing_id, l.attempt,
 CASE WHEN (l.listing_id + l.attempt) % 11 = 0 THEN NULL
      WHEN (l.listing_id + l.attempt) % 5 = 0 THEN 'Sorry, I cannot help with that.'
      WHEN (l.listing_id + l.attempt) % 7 = 0 THEN '[1, 2]'
      WHEN l.listing_id % 4 = 0 THEN concat('```json', chr(10), j, chr(10), '```')
      WHEN l.listing_id % 4 = 1 THEN concat('Here is the result: ', j, ' done.')
      ELSE j END AS raw_output
FROM (SELECT *, THREE AS attempt, concat('{"product_name":"', CASE WHEN listing_id % 23 = 0 THEN '' ELSE 'item' END, '","brand":"', brand_txt, '","category":"', category_txt,
   '","price":', CASE listing_id % 8 WHEN 0 THEN 'null' WHEN 1 THEN '"79,999"' WHEN 2 THEN '-5' WHEN 3 THEN '"N/A"' ELSE CAST(price_int AS STRING) END,
   ',"currency":"', CASE listing_id % 4 WHEN 0 THEN 'rs' WHEN 1 THEN 'usd' WHEN 2 THEN 'gbp' ELSE 'EUR' END,
   '","availability":', CASE WHEN listing_id % 29 = 0 THEN 'null' ELSE concat('"', avail_txt, '"') END,
   ',"confidence":', CASE listing_id % 6 WHEN 0 THEN '1.5' WHEN 1 THEN '0.3' WHEN 2 THEN '"high"' ELSE '0.9' END, '}') AS j FROM listings) l
"""

# Replies with every JSON type in every field, and every shape of reply around them.
ODD_REPLIES = """
SELECT listing_id,
 CASE listing_id % 9 WHEN 0 THEN j WHEN 1 THEN concat('```', chr(10), j, chr(10), '``` trailing') WHEN 2 THEN concat(j, ' {') WHEN 3 THEN concat('```JSON ', j, '```')
   WHEN 4 THEN concat('```json [1] ``` then ', j) WHEN 5 THEN concat('``` oops ``` ', j, chr(10)) WHEN 6 THEN concat(' ', j, chr(9)) WHEN 7 THEN concat(j, j) ELSE concat('x ', j) END AS raw_output
FROM (SELECT *, concat('{"product_name":', CASE listing_id % 7 WHEN 0 THEN '12' WHEN 1 THEN 'true' WHEN 2 THEN '0' WHEN 3 THEN '"x"' WHEN 4 THEN '"  Wide Lamp "' WHEN 5 THEN 'null' ELSE '1.5' END,
   CASE WHEN listing_id % 11 = 0 THEN '' ELSE concat(',"brand":', CASE listing_id % 5 WHEN 0 THEN '""' WHEN 1 THEN '"  "' WHEN 2 THEN '[]' WHEN 3 THEN '"Kent"' ELSE '"oneplus"' END) END,
   ',"category":', CASE listing_id % 3 WHEN 0 THEN '""' WHEN 1 THEN 'false' ELSE '"sofa bed"' END,
   CASE WHEN listing_id % 4 = 0 THEN '' ELSE concat(',"price":', CASE listing_id % 10 WHEN 0 THEN '12.9' WHEN 1 THEN '"Rs. 1,499"' WHEN 2 THEN '"Rs.2,500"' WHEN 3 THEN '"₹ 12,500.75"' WHEN 4 THEN 'true' WHEN 5 THEN '[5]' WHEN 6 THEN '"INR 1_000"' WHEN 7 THEN '"5d"' WHEN 8 THEN '-0.5' ELSE '"1e3"' END) END,
   ',"currency":', CASE listing_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '" USD "' WHEN 2 THEN '5' WHEN 3 THEN '"₹"' WHEN 4 THEN '"€"' ELSE '"Rupees"' END,
   ',"offer":', CASE listing_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '10' ELSE '"  10%   off "' END,
   ',"seller":', CASE listing_id % 5 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '""' ELSE '" big bazaar "' END,
   CASE WHEN listing_id % 13 = 0 THEN '' ELSE concat(',"confidence":', CASE listing_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '"0.75"' WHEN 2 THEN '-1' WHEN 3 THEN 'null' WHEN 4 THEN '0.125' WHEN 5 THEN '0.5' WHEN 6 THEN '0.375' ELSE '"nan"' END) END,
   '}') AS j FROM listings) t
"""

# Price spellings: labels, symbols, grouping, discounts by label and by value, nothing at all.
PRICE_TEXTS = """
SELECT p_partkey AS listing_id, concat(p_name, ' ',
 CASE p_partkey % 14 WHEN 0 THEN concat('Rs.', p, '/-') WHEN 1 THEN concat('Rs ', p) WHEN 2 THEN concat('INR', ' ', p) WHEN 3 THEN concat('Rupees ', p)
  WHEN 4 THEN concat('MRP: ₹', p + 500, ' | Sale: ₹', p) WHEN 5 THEN concat('Special Price: ', p) WHEN 6 THEN concat('Now ', p, ' (Was ', p + 100, ')')
  WHEN 7 THEN concat(p, ' only') WHEN 8 THEN concat('Price: INR ', p) WHEN 9 THEN concat('₹1,', p, ' flat Rs.', p, ' off') WHEN 10 THEN concat('@Rs.1,', p)
  WHEN 11 THEN concat('Offers ', p, ' in hours 24') WHEN 12 THEN concat('save ₹ ', p, ' cashback MRP ', p, ' INR ', p + 7) ELSE concat('~₹', p, ' off on exchange; ', p, ' discount') END) AS txt
FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS p FROM part) t
"""

# Dirt depends on the length of the text, so equal texts stay equal.
DIRTY = """
SELECT doc_id, concat(
 CASE n_chars % 5 WHEN 0 THEN '  <b>' WHEN 1 THEN concat(chr(9), ' ', ' ') WHEN 2 THEN '• ' WHEN 3 THEN '' ELSE '　' END,
 text,
 CASE n_chars % 4 WHEN 0 THEN concat(chr(7), ' &amp;lt; “x” – y…', chr(9), chr(9), 'z</b> ')
   WHEN 1 THEN concat(' cafe', '́', ' ‘q’ — a', ' ', 'b', chr(127), ' > ', '̸', ' ')
   WHEN 2 THEN concat(chr(10), chr(10), chr(10), chr(10), '₹ 5 < 6 > 7 &lt;i&gt;◦ ▪', chr(28), chr(13)) ELSE ' plain  end' END) AS dirty
FROM documents
"""

# UTF-8 read as Latin-1 for two thirds of the rows; a rupee sign or a raw letter spoils some.
MOJIBAKE = """
SELECT doc_id, CASE WHEN n_chars % 3 = 2 THEN text ELSE concat(
 replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
  'é', 'Ã©'), 'è', 'Ã¨'), 'ê', 'Ãª'), 'ç', 'Ã§'), 'ü', 'Ã¼'), 'ö', 'Ã¶'), 'ä', 'Ã¤'), 'ñ', 'Ã±'), 'ó', 'Ã³'), 'á', 'Ã¡'), 'É', concat('Ã', chr(137))), 'ß', concat('Ã', chr(159))), 'í', concat('Ã', chr(173))),
 CASE WHEN n_chars % 7 = 0 THEN ' ₹' WHEN n_chars % 7 = 1 THEN ' é' ELSE ' Ã©' END) END AS garbled
FROM documents
"""

VIEWS = {
    "listings": LISTINGS, "attempts": ATTEMPTS, "odd_replies": ODD_REPLIES,
    "price_texts": PRICE_TEXTS, "dirty": DIRTY, "mojibake": MOJIBAKE,
}
_NEEDS = {
    "listings": ["part"], "attempts": ["listings"], "odd_replies": ["listings"],
    "price_texts": ["part"], "dirty": ["documents"], "mojibake": ["documents"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Over all cores: the given tables are single files of one row group."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input. The views it builds on are registered along the way."""
    for needed in _NEEDS[name]:
        source = view if needed in VIEWS else table
        source(spark, sf_dir, needed).createOrReplaceTempView(needed)
    return spark.sql(VIEWS[name].replace("THREE", "explode(array(1, 2, 3))"))


def ctes(*names: str) -> str:
    """``WITH`` text that defines derived inputs for DuckDB."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*_NEEDS[name], name) if n in VIEWS and n not in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].replace('THREE', 'unnest([1, 2, 3])')})" for n in wanted)
