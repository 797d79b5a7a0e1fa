"""Text repair as Column expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import lexicon as lx
from tidyshelf.functions.html_text import unescape_strip_compose

TAG = r"<[^>]+>"
# One cheap range that covers every bullet and every repaired punctuation mark.
_GLYPHS = r"[\x{B7}\x{2013}-\x{25B8}]"
_GLYPHS_FROM = lx.BULLETS + "".join(lx.PUNCTUATION)
_GLYPHS_TO = "\n" * len(lx.BULLETS) + "".join(lx.PUNCTUATION.values())
# Characters that composing never changes and that join with none before them: Latin and phonetic
# letters, dashes, quotes and bullets, currency signs, geometric shapes, unified ideographs. A text
# of these alone needs no composer.
_SETTLED = r"\x{00}-\x{2FF}\x{2010}-\x{2027}\x{20A0}-\x{20BF}\x{25A0}-\x{25FF}\x{4E00}-\x{9FFF}"
_UNSETTLED = f"[^{_SETTLED}]"
# An ampersand that could start an entity.
_ENTITY = r"&[^\t\n\f <&;]"


def py_strip(c: Column) -> Column:
    """Strip every Unicode whitespace character at both ends (SQL ``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(lx.WHITESPACE))


def has_text(c: Column) -> Column:
    """True if some character is not whitespace."""
    return c.rlike("[^" + lx.WHITESPACE_CLASS[1:])


def py_lower_key(c: Column) -> Column:
    return py_strip(F.lower(c))


def py_title(c: Column) -> Column:
    """Capitalise each run of cased letters: ``h&m`` -> ``H&M`` (``initcap`` splits on spaces only)."""
    cased = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]+|[^\p{IsLowercase}\p{IsUppercase}\p{Lt}]+"
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(cased), 0), F.initcap), "")


def _not_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.char_length(c)


def fix_encoding(c: Column) -> Column:
    """Undo UTF-8 read as Latin-1, where the whole text allows it; else leave the text alone.

    Text with a character above U+00FF (such as the U+201A in a Windows-1252 mix-up) is left alone.
    ``encode`` raises on such characters, so the check guards it.
    """
    candidate = F.when(_not_ascii(c) & ~c.rlike(r"[^\x{00}-\x{FF}]"), c)
    return F.coalesce(F.try_validate_utf8(F.encode(candidate, "ISO-8859-1").cast("string")), c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, " ")


def _has_entity(c: Column) -> Column:
    return F.contains(c, F.lit("&")) & c.rlike(_ENTITY)


def _may_compose(c: Column) -> Column:
    return _not_ascii(c) & c.rlike(_UNSETTLED)


def remove_html(c: Column) -> Column:
    """Unescape entities, then replace each tag by one space. Script and style contents stay."""
    hard = F.when(_has_entity(c), c)
    return F.coalesce(unescape_strip_compose(hard, F.lit("html")), strip_tags(c))


def normalize_unicode(c: Column) -> Column:
    """Canonical composition (NFC)."""
    hard = F.when(_may_compose(c), c)
    return F.coalesce(unescape_strip_compose(hard, F.lit("nfc")), c)


def remove_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, lx.CONTROL_CLASS, "")


def normalize_bullets(c: Column) -> Column:
    return F.translate(c, lx.BULLETS, "\n" * len(lx.BULLETS))


def normalize_punctuation(c: Column) -> Column:
    straight = F.translate(c, "".join(lx.PUNCTUATION), "".join(lx.PUNCTUATION.values()))
    return F.replace(straight, F.lit("…"), F.lit("..."))


def normalize_whitespace(c: Column) -> Column:
    """Blank runs to one space, three or more newlines to two, then strip.

    A no-break space inside the text stays; at the ends it goes.
    """
    spaced = F.regexp_replace(c, r"[ \t]+", " ")
    gaps = F.regexp_replace(spaced, r"\n{3,}", "\n\n")
    return py_strip(F.when(F.contains(c, F.lit("\n\n\n")), gaps).otherwise(spaced))


def _repair_glyphs(c: Column) -> Column:
    # bullets and punctuation in one pass, and only where there is one
    repaired = F.replace(F.translate(c, _GLYPHS_FROM, _GLYPHS_TO), F.lit("…"), F.lit("..."))
    return F.when(_not_ascii(c) & c.rlike(_GLYPHS), repaired).otherwise(c)


def clean_description(c: Column) -> Column:
    """All repairs in order, as one expression. For a whole column use :func:`clean_column`.

    Tags are stripped before composing: ``>`` followed by U+0338 composes to one character.
    """
    fixed = fix_encoding(c)
    hard = F.when(_has_entity(fixed) | _may_compose(fixed), fixed)
    plain = F.coalesce(unescape_strip_compose(hard, F.lit("html+nfc")), strip_tags(fixed))
    return normalize_whitespace(_repair_glyphs(remove_control_chars(plain)))


def clean_column(df: DataFrame, name: str) -> DataFrame:
    """:func:`clean_description` of one column, staged so that no step is evaluated twice.

    Only rows with an entity or rare letters visit Python (the rest send null), in one stage.
    """
    fixed, hard, swept = F.col("_fixed"), F.col("_hard"), F.col("_swept")
    return (
        df.withColumn("_fixed", fix_encoding(F.col(name)))
        .withColumn("_hard", F.when(_has_entity(fixed) | _may_compose(fixed), fixed))
        .withColumn("_swept", remove_control_chars(
            F.coalesce(unescape_strip_compose(hard, F.lit("html+nfc")), strip_tags(fixed))))
        .withColumn(name, normalize_whitespace(_repair_glyphs(swept)))
        .drop("_fixed", "_hard", "_swept")
    )


def sanitize_text(c: Column) -> Column:
    """Every whitespace run to one space, then strip."""
    return py_strip(F.regexp_replace(c, lx.WHITESPACE_CLASS + "+", " "))


def format_price(price: Column, currency: Column | None = None) -> Column:
    """``99999, INR`` -> ``₹99,999``; a missing price -> ``N/A``; other currencies keep the code."""
    code = F.lit(lx.DEFAULT_CURRENCY) if currency is None else currency
    symbols = F.create_map(*[F.lit(x) for kv in lx.CURRENCY_SYMBOLS.items() for x in kv])
    shown = F.concat(F.coalesce(F.try_element_at(symbols, code), code), F.format_number(price, 0))
    return F.when(price.isNull(), F.lit("N/A")).otherwise(shown)


def text_length(c: Column) -> Column:
    """Length in characters."""
    return F.char_length(c)


def fixed2(c: Column) -> Column:
    """Two decimals, rounded from the exact binary value with ties to even, as C's ``%.2f`` does.

    ``format_string`` rounds the shortest decimal text half up, which differs (0.045, 0.125).
    The product with 100 is split in two exact parts so that the remainder has no rounding error.
    """
    head = c * F.lit(134217729.0) - (c * F.lit(134217729.0) - c)
    tail = c - head
    cents = F.floor(c * 100.0)
    rest = (head * 100.0 - (cents + F.lit(0.5))) + tail * 100.0
    up = (rest > 0) | ((rest == 0) & (F.pmod(cents, F.lit(2)) == 1))
    rounded = (cents + up.cast("int")).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")
    return rounded.cast("string")
