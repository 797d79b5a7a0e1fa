"""Price recovery from text, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyshelf import lexicon as lx
from tidyshelf.functions.json_text import _bind


def _amounts(text: Column, pattern: str) -> Column:
    """The amounts a pattern finds, left to right. Amounts beyond BIGINT become null."""
    found = F.regexp_extract_all(text, F.lit(lx.java_regex(pattern)), 1)

    def number(token: Column) -> Column:
        digits = F.translate(token, lx.DECIMAL_DIGITS + ",", lx.DECIMAL_DIGITS_ASCII)
        return digits.try_cast("bigint")

    return F.transform(found, number)


def discount_amounts(text: Column) -> Column:
    """Distinct amounts that the text calls a discount."""
    return F.array_distinct(F.concat(*[_amounts(text, p) for p in lx.DISCOUNT_PATTERNS]))


def extract_price(text: Column) -> Column:
    """The first positive amount, by pattern priority, whose value is not a discount amount."""
    nothing = F.array(F.lit(0).cast("bigint"), F.lit(None).cast("bigint"))
    excluded = F.concat(discount_amounts(text), nothing)
    return _bind(
        excluded,
        lambda bad: F.coalesce(
            *[F.get(F.array_except(_amounts(text, p), bad), F.lit(0)) for p in lx.PRICE_PATTERNS]
        ),
    )
