"""Finding and reading one JSON object in a reply text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyshelf import lexicon as lx
from tidyshelf.functions.text import py_strip



def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null.

    ``try_parse_json`` ignores what follows the first value. The text is therefore read as the
    first item of an array that ends in a mark computed from the text itself.
    """

    def checked(t: Column) -> Column:
        mark = F.xxhash64(t)
        wrapped = F.concat(F.lit("["), t, F.lit(","), mark.cast("string"), F.lit("]"))
        return _bind(
            F.try_parse_json(wrapped),
            lambda v: F.when(
                (F.try_variant_get(v, "$[1]", "bigint") == mark)
                & F.variant_get(v, "$[2]", "variant").isNull(),
                F.variant_get(v, "$[0]", "variant"),
            ),
        )

    return _bind(text, checked)


def is_json(text: Column) -> Column:
    return strict_json(text).isNotNull()


def extract_json_object(text: Column) -> Column:
    """The JSON object of a reply: a code fence first, else from the first ``{`` to the last ``}``.

    A fence that holds another valid JSON value (a list, a number, ``null``) ends the search without
    an object. The text as a whole needs no third look: if it is an object, its braces span it.
    """
    fence = F.when(F.contains(text, F.lit("```")), py_strip(F.regexp_extract(text, lx.REPLY_FENCE, 1)))
    braces = F.when(F.contains(text, F.lit("{")), F.regexp_extract(text, lx.REPLY_BRACES, 0))
    other_value = lambda f: ~F.startswith(f, F.lit("{")) & is_json(f)
    return _bind(
        fence,
        lambda f: F.coalesce(
            F.when(F.startswith(f, F.lit("{")), strict_json(f)),
            F.when(~F.coalesce(other_value(f), F.lit(False)), strict_json(braces)),
        ),
    )


def field(parsed: Column, name: str) -> Column:
    """A field as VARIANT: SQL null if absent, a VARIANT null if JSON ``null``."""
    return F.variant_get(parsed, f"$.{name}", "variant")


def field_text(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "string")


def json_kind(value: Column) -> Column:
    """``ABSENT NULL STRING BIGINT DECIMAL DOUBLE BOOLEAN OBJECT ARRAY``."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return (
        F.when(value.isNull(), F.lit("ABSENT"))
        .when(F.is_variant_null(value), F.lit("NULL"))
        .otherwise(name)
    )
