"""Groups of spelling variants by dense prefix-suffix tiling.

Two words are near if one code point inserted, deleted or replaced makes them equal: then their common
prefix and common suffix together reach the length of the longer one less one.

1. Words are counted in one aggregation over all texts; the rest works on distinct words.
2. A pair of length m (the shorter) differs in its first or in its second half. It shares the first m / 2 code
   points in the latter case and the last m - m / 2 in the former, so each word stands under four keys: first
   and second half, as the shorter and as the longer word of a pair. No near pair is left out.
3. The words of a key are one tile: a padded matrix of their remaining code points, a row for each word. Common
   prefixes and suffixes of all its rows with all its rows are counted column by column. Small tiles of equal
   width stand together in one matrix. The words of a frequent key are dealt over blocks by hash, and each pair
   of blocks is a tile of its own, so that no key fills a task.
4. A tile tells for each word how many near words it has, and which is the most frequent; these are added up.

A word's form is its near word with the largest count if that is ``factor`` times its own. Forms grow by that
factor, so following them ends after a few joins, each of which doubles the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import id_and_text
from tidyshelf.storage import Workspace

#: Letters of a word, after A-Z became a-z.
LETTERS = "[a-zÀ-ÿ]"
#: Code points of a word at least, and its occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How many times as frequent a form is as its variant.
FACTOR = 10
#: Words of a block; a key with more is dealt over several.
BLOCK = 2048
#: Rows of small tiles that are compared as one matrix, and rows of a matrix that are laid out at once.
TOGETHER, LAID_OUT = 128, 512
#: Keyed words that one task compares, about.
TASK_ROWS = 250_000


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, thinned: int | None = None) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences.

    ``thinned``: delete a code point of each run of letters whose checksum with the row's id this number
    divides. A null id has no checksum; null texts have no words.
    """
    runs = id_and_text(df, id_col, text_col).select("id", F.explode(F.regexp_extract_all(
        F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("word"))
    if thinned:
        size = F.char_length("word")
        crc = runs.withColumn("h", F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), "word").cast("binary")))
        place = (F.col("h") % size).cast("int")
        runs = crc.withColumn("word", F.when(
            F.col("h") % thinned == 0, F.concat(F.substr("word", F.lit(1), place), F.substr("word", place + 2, size))).otherwise(F.col("word")))
        runs = runs.filter(F.char_length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keyed(words: DataFrame, least_length: int) -> DataFrame:
    """Four rows per word: first: whether the piece is its beginning; m: length of the pair's shorter word;
    piece: the half that both share; rest: what is to be compared."""
    size, half = F.char_length("word"), F.expr("m div 2").cast("int")

    def key(first: bool) -> Column:
        cut = half if first else size - (F.col("m") - half)
        begin, end = F.substr("word", F.lit(1), cut), F.substr("word", cut + 1, size)
        return F.struct(F.lit(first).alias("first"), "m", (begin if first else end).alias("piece"), (end if first else begin).alias("rest"))

    each = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= least_length)
    return each.select("n", F.explode(F.array(key(True), key(False))).alias("k")).select("k.*", "n")


def _tiled(words: DataFrame, least_length: int, block: int) -> DataFrame:
    """Keyed words with the pair of blocks (x, y) in which they are compared, and their own block."""
    key = ["first", "m", "piece"]
    width = F.expr("IF(first, m - m div 2, m div 2)")
    short = F.char_length("rest") == width
    keyed = _keyed(words, least_length)
    # a key is worth a tile if it has two words, one of which is the shorter one
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("size"), F.count(F.when(short, 1)).alias("short")).filter("size > 1 AND short > 0")
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = keyed.join(sizes.select(*key, blocks.alias("blocks")), key).withColumn("own", F.pmod(F.xxhash64("rest"), "blocks").cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rest", "n")


def matrix_of(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and code points by place and word, padded with zeros; one byte each if all of them fit."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), sizes)
    column = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]
    out = np.zeros((width, len(words)), np.uint8 if not len(flat) or flat.max() < 256 else np.uint32)
    out[column, row] = flat
    return sizes, out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of all columns of a and all of b, over the rows that both have."""
    rows = min(len(a), len(b))
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    total = np.zeros(alive.shape, np.uint8 if rows < 120 else np.int32)
    for p, q in zip(a[:rows], b[:rows], strict=True):
        alive &= p[:, None] == q[None, :]
        total += alive
        if rows > 32 and not alive.any():
            break
    return total


def near_pairs(a: np.ndarray, b: np.ndarray, touching: bool) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a and of b (as wide, or one wider) that one edit makes equal, without equal ones.

    ``touching``: the shared half stands behind. A pair that shares the whole of the shorter rest
    is then left to the tile of its first half.
    """
    prefix, suffix = _common(a, b), _common(a[::-1], b[::-1])
    near = prefix + suffix >= len(b) - 1
    if touching or len(a) == len(b):
        near &= prefix < len(a)
    return np.nonzero(near)


def _pairs_of(matrix: np.ndarray, width: int, short: np.ndarray, group: np.ndarray, own: np.ndarray, cross: np.ndarray,
              first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near words of one side and width, rows sorted by tile: (word, near word), both ways."""
    bounds = np.concatenate((np.flatnonzero(np.diff(group, prepend=-1)), [len(group)]))
    at = 0
    while at + 1 < len(bounds):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TOGETHER, side="right")) - 1)
        rows = np.arange(bounds[at], bounds[to])
        a, b = rows[short[rows]], rows[~short[rows]]
        for left, right, wide in ((a, a, width), (a, b, width + 1)):
            for i in range(0, len(left), LAID_OUT):
                p = left[i : i + LAID_OUT]
                for j in range(0, len(right), LAID_OUT):
                    q = right[j : j + LAID_OUT]
                    x, y = near_pairs(matrix[:width, p], matrix[:wide, q], not first)
                    x, y = p[x], q[y]
                    good = (group[x] == group[y]) & ((own[x] != own[y]) | ~cross[x])
                    x, y = x[good], y[good]
                    yield x, y
                    if wide > width:
                        yield y, x
        at = to


def _counted(rows: pa.Table) -> pa.RecordBatch:
    """Rows of whole tiles, sorted by tile: per word and tile the near words and the most frequent of them."""
    m, first = (rows.column(c).to_numpy() for c in ("m", "first"))
    piece, rest = rows.column("piece").combine_chunks(), rows.column("rest").combine_chunks()
    x, y, own, n = (rows.column(c).to_numpy() for c in ("x", "y", "own", "n"))
    moved = np.diff(m) != 0
    for c in (x, y, first.astype(np.int8)):
        moved |= np.diff(c) != 0
    moved |= pc.not_equal(piece[1:], piece[:-1]).to_numpy(zero_copy_only=False)
    group = np.concatenate(([0], np.cumsum(moved)))
    mask = pa.array(first)
    word = pc.binary_join_element_wise(pc.if_else(mask, piece, rest), pc.if_else(mask, rest, piece), "")
    rank = np.empty(len(word), np.int64)
    rank[pc.sort_indices(word).to_numpy()] = np.arange(len(word))
    rests = rest.to_pylist()
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    cuts = np.concatenate(([0], np.flatnonzero((np.diff(m) != 0) | (np.diff(first.astype(np.int8)) != 0)) + 1, [len(m)]))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        width = int(m[low] - m[low] // 2 if first[low] else m[low] // 2)
        sizes, matrix = matrix_of(rests[low:high], width + 1)
        part = slice(low, high)
        for a, b in _pairs_of(matrix, width, sizes == width, group[part], own[part], (x != y)[part], bool(first[low])):
            found.append((a + low, b + low))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.diff(a, prepend=-1))
    times = np.diff(np.concatenate((head, [len(a)])))
    return pa.RecordBatch.from_arrays(
        [word.take(a[head]), pa.array(times), word.take(b[head]), pa.array(n[b[head]])], ["word", "near", "best", "best_n"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, kept = ["first", "m", "piece", "x", "y"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        kept = rows if kept is None else pa.concat_tables([kept, rows])
        # the last tile may go on in the next batch
        last = kept.slice(kept.num_rows - 1).to_pylist()[0]
        same = pc.equal(kept.column("piece"), last["piece"]).to_numpy()
        for c in key:
            if c != "piece":
                same = same & (kept.column(c).to_numpy() == last[c])
        whole = int(np.argmax(same))
        if whole:
            yield _counted(kept.slice(0, whole))
            kept = kept.slice(whole)
    if kept is not None:
        yield _counted(kept)


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near words; of equally frequent ones the smallest is best."""
    shards = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * words.count() // TASK_ROWS + 1)
    key = ["first", "m", "piece", "x", "y"]
    tiles = _tiled(words, least_length, block).repartition(shards, *key).sortWithinPartitions(*key)
    near = tiles.mapInArrow(_compared, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return near.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thinned: int | None = None, factor: int = FACTOR,
                      least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, block: int = BLOCK,
                      workspace: Workspace | None = None) -> DataFrame:
    """Per distinct word: word, form, root, n, n_near, form_n.

    Words are maximal runs of letters, A-Z lower-cased, with so many code points and occurrences. A word's
    form is the near word that occurs most (of equal ones the first in code-point order) if it occurs
    ``factor`` times as often, else null; the root is where following forms ends. Null, empty and blank
    texts have no words; repeated rows count each time; an empty table gives an empty one. Other columns
    are not read. ``thinned``: see ``count_words``.
    """
    store = workspace or Workspace(df.sparkSession)
    words = store.freeze(count_words(df, id_col, text_col, least_length, least_count, thinned), "words")
    formed = F.col("best_n") >= factor * F.col("n")
    known = store.freeze(words.join(near_words(words, least_length, block), "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    way = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = store.freeze(way.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        way = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return known.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
