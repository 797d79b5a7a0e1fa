"""Table contracts."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("raw_description", T.StringType(), False),
])

ATTEMPT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("raw_output", T.StringType()),
])

CLEAN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("offer", T.StringType()),
    T.StructField("availability", T.StringType()),
    T.StructField("delivery", T.StringType()),
    T.StructField("seller", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("raw_description", T.StringType()),
])

ERROR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("raw_description", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_detail", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("llm_raw_output", T.StringType()),
])

CLEAN_COLUMNS = CLEAN_SCHEMA.fieldNames()
ERROR_COLUMNS = ERROR_SCHEMA.fieldNames()
PRODUCT_FIELDS = CLEAN_COLUMNS[1:11]
