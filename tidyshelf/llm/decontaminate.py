"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton over words accepts every run of words of every item. A document streams through it: after
each word the automaton knows the longest run ending there that some item has. Where that run reaches
the window length (or is a whole shorter item), the words below it are hit. Documents over the limits
are contaminated; cleaning cuts the hit spans.

Items are dealt into blocks of at most ``BLOCK_WORDS`` words, each with an automaton of bounded size that
is broadcast; every block sees all documents, and hits of a document are united by row. One block, the
usual case, needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import id_and_text, texts_in, unused
from tidyshelf.storage import Workspace

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Words of items in one automaton; it has at most twice as many states.
BLOCK_WORDS = 500_000

#: Word bytes: digits, lower-case letters and all bytes of characters beyond ASCII.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.number, self.names = window, {}, [name for name, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        #: state of a window -> items; short items: state -> [(length, items)]
        self.windows: dict[int, tuple[int, ...]] = {}
        self.shorts: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        coded = [[self.number.setdefault(w, len(self.number) + 1) for w in words] for _, words in items]
        for sequence in coded:
            last = 0
            for c in sequence:
                last = self._extend(last, c)
        self._mark(coded)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length), self.link.append(link), self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # another item has this run already
            return self._split(last, c, self.next[last][c])
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def holder(self, state: int, n: int) -> int:
        """The state of the last n words of what has been read."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, coded: list[list[int]]) -> None:
        windows: dict[int, set[int]] = {}
        shorts: dict[int, dict[int, set[int]]] = {}
        for item, sequence in enumerate(coded):
            state = length = 0
            for c in sequence:
                state, length = self.step(state, length, c)
                if len(sequence) >= self.window and length >= self.window:
                    windows.setdefault(self.holder(state, self.window), set()).add(item)
            if 0 < len(sequence) < self.window:
                self.shortest = min(self.shortest, len(sequence))
                shorts.setdefault(self.holder(state, len(sequence)), {}).setdefault(len(sequence), set()).add(item)
        self.windows = {s: tuple(v) for s, v in windows.items()}
        self.shorts = {s: [(n, tuple(v)) for n, v in by.items()] for s, by in shorts.items()}

    def read(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [from, to) of the words, in order of their ends, and the items hit."""
        known = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (known > 0).view(np.int8), [0]))))
        spans, items = [], set()
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start >= self.shortest:  # a window cannot span an unknown word
                self._run(known[start:end].tolist(), start, spans, items)
        return spans, items

    def _run(self, run: list[int], start: int, spans: list, items: set) -> None:
        state = length = 0
        for i, c in enumerate(run, start + 1):
            state, length = self.step(state, length, c)
            if length >= self.window:
                owners = self.windows.get(self.holder(state, self.window))
                if owners:
                    spans.append((i - self.window, i))
                    items.update(owners)
            if self.shorts:
                at, n = state, length
                while at > 0:
                    for size, owners in self.shorts.get(at, ()):
                        if size <= n:
                            spans.append((i - size, i))
                            items.update(owners)
                    at = self.link[at]
                    n = self.length[at]


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> list[list[tuple[str, list[bytes]]]]:
    """The stated test items, in blocks of bounded size, smallest id first; nulls have no words."""
    blocks, size = [[]], 0
    for row in id_and_text(items, item_col, text_col).orderBy("id").toLocalIterator():
        words = words_of(row["text"])
        if blocks[-1] and size + len(words) > block_words:
            blocks.append([])
            size = 0
        if words:
            blocks[-1].append((str(row["id"]), words))
            size += len(words)
    return blocks


def _hits(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        for batch in batches:
            out = {"n_words": [], "spans": [], "items": []}
            for _, texts in texts_in([batch]):
                for text in texts:
                    words = words_of(text)
                    spans, items = automaton.read(words)
                    out["n_words"].append(len(words))
                    out["spans"].append([x for s in covered(spans) for x in s])
                    out["items"].append(sorted({automaton.names[i] for i in items}))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["spans"], pa.list_(pa.int64())),
                pa.array(out["items"], pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return task


def find_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", block_words: int = BLOCK_WORDS, window: int = WINDOW,
              workspace: Workspace | None = None) -> DataFrame:
    """Per row: id, n_words, spans (flat list of word positions from, to), items (distinct ids as strings).

    Null and empty texts have no words; repeated rows and null ids come back as they are; empty tables
    give no rows or no hits; other columns are not read.
    """
    spark = df.sparkSession
    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    hit = "n_words long, spans array<long>, items array<string>"
    if len(blocks) == 1:
        shared = spark.sparkContext.broadcast(Automaton(blocks[0], window))
        return source.mapInArrow(_hits(shared), f"id {kind}, {hit}")
    store = workspace or Workspace(spark)
    rows = store.freeze(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    united = None
    for block in blocks:  # a stated set of items, block by block, against all rows
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        found = rows.select("row", "text").mapInArrow(_hits(shared), f"id long, {hit}")
        # the first block also tells how many words each row has
        part = store.freeze(found if united is None else found.filter(F.size("spans") > 0), "block")
        united = part if united is None else united.unionByName(part)
    by_row = united.groupBy(F.col("id").alias("row")).agg(
        F.max("n_words").alias("n_words"), F.collect_list("spans").alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    return rows.select("id", "row").join(by_row, "row").select("id", "n_words", _union(F.col("s")).alias("spans"), F.array_distinct("i").alias("items"))


def _unite(spans):
    """The union of the blocks' spans of one row."""
    flat = lambda rows: [(int(a), int(b)) for r in rows for a, b in zip(r[::2], r[1::2], strict=True)]
    return spans.map(lambda rows: [x for s in covered(flat(rows)) for x in s])


def _union(spans):
    return F.pandas_udf(_unite, "array<long>")(spans)


def hit_columns(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The digest of ``find_hits``: n_hit, n_items, items_sha256 and the verdict."""
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct(
        (a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")))["n"]
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn(
        "items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def remove_spans(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    raw = text.encode()
    plain = raw.translate(_TO_WORDS) + b" "
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[last : starts[a]])
        last = ends[b - 1]
    out.append(raw[last:])
    return b"".join(out).decode()


def _cut(text: str | None, n_words: int, spans: list[int], one_in: int) -> str | None:
    hit = sum(spans[1::2]) - sum(spans[::2])
    return remove_spans(text, spans) if hit and one_in * hit >= n_words else text


def clean_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                    block_words: int = BLOCK_WORDS, window: int = WINDOW, one_in: int = ONE_IN, workspace: Workspace | None = None) -> DataFrame:
    """All rows and columns of ``df``; contaminated texts lose their hit spans, others stay as they are.

    Texts without words and nulls stay; so do all rows of an empty benchmark.
    """
    names = list(df.columns)
    row, n_words, hit = unused(df, "row_number", "n_words", "hit_spans")
    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    automaton = Automaton(blocks[0], window) if len(blocks) == 1 else None
    shared = df.sparkSession.sparkContext.broadcast(automaton)
    rows = df.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value
        for batch in batches:
            texts, at = batch.column(text_col).to_pylist(), batch.schema.get_field_index(text_col)
            if reader is None:
                found = zip(batch.column(n_words).to_pylist(), batch.column(hit).to_pylist(), strict=True)
            else:
                words = map(words_of, texts)
                found = ((len(w), [x for s in covered(reader.read(w)[0]) for x in s]) for w in words)
            out = [_cut(t, n, spans, one_in) for t, (n, spans) in zip(texts, found, strict=True)]
            yield batch.set_column(at, text_col, pa.array(out, pa.string())).select(names)

    if automaton is None:
        store = workspace or Workspace(df.sparkSession)
        rows = store.freeze(rows.withColumn(row, F.monotonically_increasing_id()), "documents")
        found = find_hits(rows, benchmark, row, text_col, item_col, item_text_col, block_words, window, workspace=store)
        rows = rows.join(found.select(F.col("id").alias(row), F.col("n_words").alias(n_words), F.col("spans").alias(hit)), row)
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(task, kinds)
