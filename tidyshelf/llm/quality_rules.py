"""Quality rules, line first, in built-in functions only.

Every line with a word is judged by itself: menus (cells parted by bars), boilerplate phrases, symbol
litter, lines where words carry stacked marks, shouting, and lines equal to an earlier one. Failed
lines go. A document is rejected if it has too few words, repeats itself, or loses too much of its text.

Nothing is shuffled: all counts come from array functions on the row. Sorted hashes of three-word windows
bring equal windows together; words are compared before two windows count as equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if more than this share of its words stood in failed lines.
MAX_LOST_PERCENT = 50
#: The share of a line's words that may be symbols, or words with stacked marks.
MAX_SYMBOL_PERCENT = 50
#: The same for bars between cells, which count as words themselves.
MAX_BAR_PERCENT = 30
MIN_LINE_WORDS = 3
#: Symbols that the counts of the digest name.
SYMBOLS = "#*$%&|<>"
#: Lines of more words are prose, whatever phrase they hold.
MAX_PHRASE_LINE_WORDS = 12
#: Fixed phrases of site furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "click here", "read more", "sign up", "log in", "subscribe now", "share this", "follow us", "lorem ipsum",
    "javascript is disabled", "skip to content", "back to top",
)
#: Bits that hold a window's place beside its hash.
PLACE_BITS = 20
_BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r")


def _replace(c: Column, what: str, by: str) -> Column:
    return F.replace(c, F.lit(what), F.lit(by))


def _words(c: Column) -> Column:
    """Runs of characters that are none of the six blanks."""
    return F.array_remove(F.split(reduce(lambda x, b: _replace(x, b, " "), _BLANKS, c), " "), "")


def _count(c: Column, strings) -> Column:
    """How many bytes the given strings take. A loop over a constant array keeps the generated code short."""
    return F.aggregate(F.array(*map(F.lit, strings)), F.lit(0), lambda n, x: n + F.octet_length(c) - F.octet_length(F.replace(c, x, F.lit(""))))


def _any(c: Column, phrases) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p))


def _shouts(line: Column, low: Column) -> Column:
    """Upper case throughout, with a character that has a lower case."""
    return (line == F.upper(line)) & (line != low)


def _line_fails(x: Column) -> Column:
    """A verdict on one line by itself; fields: line, low (lower case), n (words)."""
    line, n = x["line"], x["n"]
    over = lambda count, percent: count * 100 > n * percent
    alone = (
        over(_count(line, "|"), MAX_BAR_PERCENT)
        | over(_count(line, "#*$%&<>"), MAX_SYMBOL_PERCENT)
        | over(_count(line, ("!!", "??")) / 2, MAX_SYMBOL_PERCENT)
        | _shouts(line, x["low"])
    )
    return ((n >= MIN_LINE_WORDS) & alone) | ((n <= MAX_PHRASE_LINE_WORDS) & _any(x["low"], BOILERPLATE))


def _suspect(text: Column, low: Column, lines: Column) -> Column:
    """False for texts in which no line can fail by itself: each rule implies one of these signs."""
    return text.rlike(r"[#*$%&|<>]|!!|\?\?") | _any(low, BOILERPLATE) | F.exists(lines, lambda x: _shouts(x, F.lower(x)))


def _window(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", *(F.element_at(words, i + k) for k in (1, 2, 3)))


def _twins(words: Column, placed: Column, place) -> Column:
    """Per pair of neighbours of one hash: their places, or an empty array if their words differ."""
    return F.filter(F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.when(
        place(a)[0] == place(b)[0],
        F.when(_window(words, place(a)[1]) == _window(words, place(b)[1]), F.array(place(a)[1], place(b)[1]))
        .otherwise(F.array().cast("array<int>")))), lambda t: t.isNotNull())


def _places(twins: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(twins)))


def _covered(places: Column) -> Column:
    """The size of the union of [i, i + 2] over sorted places i."""
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda p, q: F.coalesce(F.least(q - p, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda a, s: a + s)


def judge_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words
    and, with ``cleaned``, clean_text: the lines that did not fail.

    Null and empty texts have no words, fail the base rule and are not kept. Repeated rows and null ids
    come back as they are; an empty table gives an empty one; other columns are not read.
    """
    n, words = F.col("n_words"), F.col("words")
    base = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).select(
        "id", "text", _words(F.col("text")).alias("words"),
        # a line without a word can neither repeat nor fail
        F.filter(F.split("text", "\n"), lambda x: F.octet_length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0).alias("lines"),
    ).select(
        "id", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.array_distinct("lines").alias("own"), F.size("lines").alias("n_lines"),
        F.when(F.size("words") > 3, F.transform(
            F.sequence(F.lit(1), F.size("words") - 2),
            lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2)),
        )).alias("hashes"),
    )
    # hash and place of a window in one number: numbers sort fast. If two windows share the shortened hash
    # but not the words, or the places do not fit, the whole hash, words and place are sorted instead.
    mask = (1 << PLACE_BITS) - 1
    packed = F.sort_array(F.transform("hashes", lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    quick = base.select("*", F.when(n <= mask, packed).alias("packed"))
    quick = quick.select("*", _twins(words, F.col("packed"), lambda x: (
        x.bitwiseAND(F.lit(~mask)), x.bitwiseAND(F.lit(mask)).cast("int"))).alias("twins"))
    unsure = F.exists("twins", lambda t: F.size(t) == 0) | (n > mask)
    whole = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), _window(words, i).alias("w"), i.alias("i"))))
    sure = quick.select("*", F.when(unsure, whole).alias("whole")).drop("packed", "hashes")
    sure = sure.select("*", F.when(F.col("whole").isNull(), F.col("twins")).otherwise(_twins(
        words, F.col("whole"), lambda x: (F.struct(x["h"], x["w"]), x["i"]))).alias("pairs")).drop("whole", "twins")
    staged = sure.select("*", _places(F.col("pairs")).alias("places"), F.lower("text").alias("low_text")).drop("pairs", "words")
    blanks = _count(F.col("text"), (" ", *_BLANKS))
    n_dup = (F.col("n_lines") - F.size("own")).cast("long")
    judged = F.transform("own", lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"), F.size(_words(x)).alias("n")))
    counted = staged.select(
        "id", "text", "own", n,
        (F.char_length("text") - blanks).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"), n_dup.alias("n_dup_lines"),
        F.coalesce(_covered(F.col("places")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when((n_dup > 0) | _suspect(F.col("text"), F.col("low_text"), F.col("own")), judged).alias("judged"),
    )
    left = counted.select("*", F.filter("judged", lambda x: ~_line_fails(x)).alias("left"))
    lost = F.coalesce(n - F.aggregate("left", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long"))
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    out = left.select("*", lost.alias("lost_words"), failed.alias("base_failed"))
    kept = ~F.col("base_failed") & (F.col("lost_words") * 100 <= n * MAX_LOST_PERCENT)
    columns = [F.col("id").alias(id_col), n, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
               kept.alias("kept"), "lost_words"]
    judged = out.select(*columns, *([F.array_join(F.coalesce(F.transform("left", lambda x: x["line"]), "own"), "\n").alias("clean_text")] if cleaned else []))
    # counting rows is a stage the optimizer does not cross: a filter on the verdict would otherwise be rewritten
    # in terms of the text, with a copy of every stage per use
    return judged.observe(f"judged_{judged.semanticHash()}", F.count(F.lit(1)).alias("rows"))
