"""Field rules, violations, and routing to the clean or the error table."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import lexicon as lx
from tidyshelf.functions.price import extract_price
from tidyshelf.functions.text import fixed2, py_lower_key, py_strip
from tidyshelf.operators.columns import conform
from tidyshelf.schemas import CLEAN_SCHEMA, ERROR_SCHEMA, PRODUCT_FIELDS

PARSE_ERROR_DETAIL = "The extractor returned no valid JSON after all retries"

# A number as Python's float() reads it (ASCII digits); infinities and NaN are handled apart.
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_INFINITE = r"(?i)^[+-]?(inf|infinity|nan)$"
_TEXT_FIELDS = ["product_name", "brand", "category"]
_OPTIONAL_TEXT = ["offer", "delivery", "seller"]
_MIN_LENGTH = {"product_name": 2, "brand": 1}
_NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]

# Messages of the violation codes, as the public pydantic documentation words them.
_MESSAGES = {
    "missing": "Field required",
    "string_type": "Input should be a valid string",
    "greater_than_equal": "Input should be greater than or equal to 0",
}


def _to_double(text: Column) -> Column:
    number = F.when(text.rlike(_FLOAT), F.replace(text, F.lit("_"), F.lit("")))
    return number.try_cast("double")


def _truncate(number: Column) -> Column:
    """Drop the fraction; what BIGINT cannot hold becomes null (the reference has no such bound)."""
    return number.try_cast("bigint")


def coerce_price(kind: Column, text: Column, strict_compat: bool = False) -> Column:
    """Whole-number price from a JSON value given by its kind and its text.

    Numbers and true/false truncate; texts lose ``₹``, ``Rs``, ``INR`` and commas first; whatever
    still is no number, infinities included, is null. Deviation: the dot of ``Rs.`` goes too, so
    ``Rs.1,499`` is 1499; ``strict_compat`` keeps the dot (and reads 0).
    """
    bare = F.regexp_replace(text, "₹|Rs|INR" if strict_compat else r"₹|Rs\.?|INR", "")
    cleaned = py_strip(F.replace(bare, F.lit(","), F.lit("")))
    return (
        F.when(kind == "BIGINT", text.try_cast("bigint"))
        .when(kind.isin(_NUMBERS), _truncate(text.try_cast("double")))
        .when(kind == "BOOLEAN", (text == "true").cast("bigint"))
        .when(kind == "STRING", _truncate(_to_double(cleaned)))
    )


def normalize_currency(text: Column) -> Column:
    """Known spellings to a code; anything else, missing included, is the default currency."""
    codes = F.create_map(*[F.lit(x) for kv in lx.CURRENCY_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, py_lower_key(text)), F.lit(lx.DEFAULT_CURRENCY))


def clamp_confidence(kind: Column, text: Column) -> Column:
    """A number cut to [0, 1]; anything that is no number is 0. The texts nan and inf clamp to 1."""
    stripped = py_strip(text)
    spelled = F.when(
        stripped.rlike(_INFINITE),
        F.when(F.lower(stripped).isin("-inf", "-infinity"), 0.0).otherwise(1.0),
    )
    value = (
        F.when(kind.isin(_NUMBERS), text.try_cast("double"))
        .when(kind == "BOOLEAN", (text == "true").cast("double"))
        .when(kind == "STRING", F.coalesce(_to_double(stripped), spelled))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def strip_text(kind: Column, text: Column) -> Column:
    """Required text: strip; numbers and true become text; null, 0, false and empty lists do not."""
    number = text.try_cast("double")
    whole_float = (kind == "DECIMAL") & ~F.contains(text, F.lit(".")) & (F.abs(number) < 1e16)
    return (
        F.when(kind == "STRING", py_strip(text))
        .when(kind.isin(_NUMBERS) & (number != 0),
              F.when(whole_float, F.concat(text, F.lit(".0"))).otherwise(text))
        .when((kind == "BOOLEAN") & (text == "true"), F.lit("True"))
        .when(kind.isin("ARRAY", "OBJECT") & ~text.isin("[]", "{}"), text)
    )


def _with_kinds(df: DataFrame) -> DataFrame:
    """``_k_<field>`` and ``_t_<field>``: JSON kind and text, as ``json_kind`` and ``field_text``.

    Written as SQL text: one call per column keeps the driver's plan building short.
    """
    extra = {}
    for n in PRODUCT_FIELDS:
        value = f"variant_get(parsed, '$.{n}', 'variant')"
        extra[f"_k_{n}"] = F.expr(
            f"CASE WHEN {value} IS NULL THEN 'ABSENT' WHEN is_variant_null({value}) THEN 'NULL' "
            f"ELSE regexp_extract(schema_of_variant({value}), '^[A-Z]+', 0) END"
        )
        extra[f"_t_{n}"] = F.expr(f"try_variant_get(parsed, '$.{n}', 'string')")
    return df.withColumns(extra)


def typed_fields(df: DataFrame, strict_compat: bool = False) -> DataFrame:
    """The ten product columns from ``parsed``, each coerced by its rule.

    A price that is absent or null is looked for in ``raw_description``.
    """
    kind = {n: F.col(f"_k_{n}") for n in PRODUCT_FIELDS}
    text = {n: F.col(f"_t_{n}") for n in PRODUCT_FIELDS}
    no_price = F.col("parsed").isNotNull() & kind["price"].isin("ABSENT", "NULL")
    found = F.when(no_price, extract_price(F.col("raw_description")))
    values = {n: strip_text(kind[n], text[n]) for n in _TEXT_FIELDS}
    values["price"] = F.coalesce(coerce_price(kind["price"], text["price"], strict_compat), found)
    values["currency"] = normalize_currency(text["currency"])
    values |= {n: F.when(kind[n] == "STRING", text[n]) for n in _OPTIONAL_TEXT}
    values["availability"] = F.when(
        kind["availability"] == "ABSENT", F.lit("Unknown")
    ).when(kind["availability"] == "STRING", text["availability"])
    values["confidence"] = clamp_confidence(kind["confidence"], text["confidence"])
    return _with_kinds(df).withColumns(values)


def violations() -> Column:
    """Every broken rule of a row, in field order, as ``array<struct<field,type,msg>>``."""

    def entry(name: str, code: str, msg: str | None = None) -> str:
        return f"named_struct('field', '{name}', 'type', '{code}', 'msg', '{msg or _MESSAGES[code]}')"

    found = []
    for name in PRODUCT_FIELDS:
        kind = f"_k_{name}"
        if name in _TEXT_FIELDS:
            rule = f"WHEN {kind} = 'ABSENT' THEN {entry(name, 'missing')}"
            rule += f" WHEN {name} IS NULL THEN {entry(name, 'string_type')}"
            if name in _MIN_LENGTH:
                least = _MIN_LENGTH[name]
                msg = f"String should have at least {least} character{'s' if least > 1 else ''}"
                rule += f" WHEN char_length({name}) < {least} THEN {entry(name, 'string_too_short', msg)}"
        elif name == "price":
            rule = f"WHEN price < 0 THEN {entry(name, 'greater_than_equal')}"
        elif name == "availability":
            rule = f"WHEN {kind} NOT IN ('ABSENT', 'STRING') THEN {entry(name, 'string_type')}"
        elif name in _OPTIONAL_TEXT:
            rule = f"WHEN {kind} NOT IN ('ABSENT', 'NULL', 'STRING') THEN {entry(name, 'string_type')}"
        elif name == "confidence":
            rule = f"WHEN {kind} = 'ABSENT' THEN {entry(name, 'missing')}"
        else:
            continue
        found.append(f"CASE {rule} END")
    return F.expr(f"filter(array({', '.join(found)}), v -> v IS NOT NULL)")


def _computed_once(df: DataFrame) -> DataFrame:
    """Keep later filters and projections from being merged into the column rules.

    A filter on ``error_type`` would otherwise be rewritten in terms of the reply, with a copy of
    every rule per use. Rows are counted on the way (a metric), which the optimizer does not cross.
    The metric is named after the plan, so that equal plans stay equal.
    """
    return df.observe(f"validated_{df.semanticHash()}", F.count(F.lit(1)).alias("rows"))


def validate(df: DataFrame, threshold: float = 0.5, strict_compat: bool = False) -> DataFrame:
    """Tag rows of ``id, raw_description, parsed, retry_count, llm_raw_output`` with their outcome.

    ``error_type`` is ``json_parse_error`` without a JSON object, else ``validation_error`` with any
    violation, else ``low_confidence`` below the threshold, else null.
    """
    low = F.col("confidence") < F.lit(threshold)
    checked = typed_fields(df, strict_compat).withColumn(
        "violations", F.when(F.col("parsed").isNotNull(), violations())
    )
    error = (
        F.when(F.col("parsed").isNull(), F.lit("json_parse_error"))
        .when(F.size("violations") > 0, F.lit("validation_error"))
        .when(low, F.lit("low_confidence"))
    )
    detail = (
        F.when(F.col("error_type") == "json_parse_error", F.lit(PARSE_ERROR_DETAIL))
        .when(F.col("error_type") == "validation_error", F.to_json("violations"))
        .when(
            F.col("error_type") == "low_confidence",
            F.concat(F.lit("Confidence "), fixed2(F.col("confidence")),
                     F.lit(f" < threshold {threshold:.2f}")),
        )
    )
    tagged = checked.withColumn("error_type", error).withColumn("error_detail", detail)
    return _computed_once(tagged.select(
        "id", "raw_description", *PRODUCT_FIELDS, "violations", "error_type", "error_detail",
        "retry_count", "llm_raw_output",
        F.when(F.col("error_type").isNull(), F.lit("success")).alias("processing_status"),
    ))


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, errors) of a tagged table. Write or persist it first: both sides read it."""
    clean = tagged.filter(F.col("error_type").isNull())
    errors = tagged.filter(F.col("error_type").isNotNull())
    return conform(clean, CLEAN_SCHEMA), conform(errors, ERROR_SCHEMA)


def enum_conformance(clean: DataFrame) -> DataFrame:
    """Share of rows inside each declared value set, one row per field."""
    inside = {
        name: F.coalesce(F.avg(F.col(name).isin(values).cast("int")), F.lit(0.0))
        for name, values in lx.DECLARED_VALUES.items()
    }
    pairs = [F.struct(F.lit(n).alias("field"), s.alias("share")) for n, s in inside.items()]
    return clean.agg(F.array(*pairs).alias("_all")).select(F.inline("_all"))
