"""Token counts: a map-side lookup in two tiers.

A text is cut at single spaces between two visible characters. No pre-token of the byte-level pattern
crosses such a place, so the text's token count is the sum over its pieces. Tier one is a broadcast
table with the lengths of the most frequent pieces, bounded by ``TABLE_SIZE`` entries of at most
``MAX_PIECE`` characters; tier two is a bounded cache in each worker. There is no shuffle of pieces:
only each task's own most frequent ones leave it, to choose the table. The choice touches speed alone,
never a count.

Texts with runs of white space, with characters beyond the Latin blocks or with a special token's
string go to the library whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import batch_of, id_and_text, texts_in
from tidyshelf.llm.tokens import TAME, PieceLengths, encode_ids, load_json

TABLE_SIZE = 16_384
#: Pieces that one task proposes for the table.
PER_TASK = 4_096
MAX_PIECE = 32
#: Leading pieces that a worker keeps.
HEAD_ROOM = 100_000


def cut(text: str, special: tuple[str, ...]) -> list[str] | None:
    """The text's pieces, each but the first with its space; None if it must be encoded whole."""
    if not text or (not text.isascii() and max(text) >= TAME) or any(s in text for s in special):
        return None
    parts = text.split(" ")
    if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        return None
    return parts


def _special(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def _frequent(path: str, per_task: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = _special(load_json(path))
        schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])
        seen: Counter = Counter()
        for _, texts in texts_in(batches):
            for text in texts:
                seen.update((cut(text, special) or [])[1:])
            if len(seen) > 64 * per_task:  # bounded memory; a lossy count is enough for a choice
                seen = Counter(dict(seen.most_common(8 * per_task)))
        top = [(p, n) for p, n in seen.most_common(per_task) if len(p) <= MAX_PIECE]
        yield batch_of(schema, piece=[p for p, _ in top], n=[n for _, n in top])

    return task


def frequent_lengths(df: DataFrame, path: str, text_col: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """Token counts of the most frequent pieces, counted over all texts; at most ``size`` entries."""
    source = id_and_text(df, text_col, text_col)
    counted = source.mapInArrow(_frequent(path, PER_TASK), "piece string, n long")
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    pieces = [r["piece"] for r in top.collect()]
    tokenizer = load_json(path)
    return {p: len(ids) for p, ids in zip(pieces, encode_ids(tokenizer, [f" {p}" for p in pieces]), strict=True)}


@lru_cache(maxsize=2)
def _lengths(path: str, table: tuple[tuple[str, int], ...]) -> tuple[PieceLengths, PieceLengths]:
    """What a worker keeps for a tokenizer's file and table: counts of pieces behind a space, and of those that lead a text."""
    tokenizer = load_json(path)
    measure = lambda texts: [len(ids) for ids in encode_ids(tokenizer, texts)]
    return PieceLengths(lambda pieces: measure([f" {p}" for p in pieces]), dict(table)), PieceLengths(measure, room=HEAD_ROOM)


def _count(path: str, table):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_json(path)
        special = _special(tokenizer)
        later, first = _lengths(path, table.value)
        for ids, texts in texts_in(batches, 2 << 20):
            cuts = [cut(t, special) for t in texts]
            counts = first.sums([c[:1] if c else [] for c in cuts]) + later.sums([c[1:] if c else [] for c in cuts])
            whole = [i for i, (t, c) in enumerate(zip(texts, cuts, strict=True)) if t and c is None]
            for i, own in zip(whole, encode_ids(tokenizer, [texts[i] for i in whole]), strict=True):
                counts[i] = len(own)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    return task


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, table_size: int = TABLE_SIZE) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts count 0; repeated rows and null ids come back as they are; an empty table
    gives an empty one; other columns are not read, so their names cannot clash.
    """
    source = id_and_text(df, id_col, text_col)
    lengths = frequent_lengths(df, path, text_col, table_size)
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(lengths.items())))
    kind = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(_count(path, shared), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
