"""Interpolated modified Kneser-Ney scoring with a bigram model counted in Spark.

Counting. Tasks turn texts into word hashes and send each shard its distinct words and bigrams with their
counts, sorted and packed. A shard adds them up and stores a sorted hash array with counts in the shared
folder. A bigram's shard follows from its first word, so a context's totals are complete in one shard;
contexts with more than a quarter of a shard's tokens are dealt by both words, and their totals added
afterwards. Continuation counts and context totals travel on to the shards of words.

Scoring. Workers map the arrays into memory and look up the sorted distinct words and bigrams of some
megabytes of text at a time, so pages are read in order and no worker holds the model.

The shared folder must be mounted by all workers (a ``file:`` path). Single words are named by 64 bits,
the two words of a bigram by 40 bits each.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import Hashes, chain, crc_of, id_and_text, texts_in
from tidyshelf.storage import Workspace

#: Texts whose words are counted or looked up together, in bytes.
PIECE_BYTES = 6 << 20
#: Tokens per shard.
SHARD_TOKENS = 2_500_000
#: The end of a text is a token; its start is a context only.
END, START = 1 << 62, 3 << 61
_SHORT = np.uint64(24)


def local_path(uri: str) -> str:
    path = uri.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError("the model's folder must be mounted by all workers, as a file: path")
    return path


def streams(texts: list[str], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text closed by END, and the texts' bounds."""
    words, bounds = [], [0]
    for text in texts:
        w = hashes.array(text.encode().lower().split())
        words += [w, np.array([END], np.uint64)]
        bounds.append(bounds[-1] + len(w) + 1)
    return np.concatenate(words) if words else np.empty(0, np.uint64), np.array(bounds)


def contexts(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each token, START for the first."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[bounds[:-1]] = START
    return before


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers of any width, byte planes together, compressed; for sorted ones pass their steps."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def spread(body: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(width, -1)
    return planes.T.copy().view(dtype).ravel()


def _steps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=np.uint64(0))


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, int(cuts[s]), int(cuts[s + 1])


_PACKED = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("values", pa.binary())])
_PACKED_SQL = "shard int, kind string, keys binary, values binary"


def _pack_words(kind: str, keys: np.ndarray, values: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows for the shards of words; values has a row of numbers per key."""
    short = keys >> _SHORT if kind == "uni" else keys
    shard = (short % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((keys, shard))
    keys, values, rows = keys[order], values[order], []
    for s, a, b in _by_shard(shard[order], shards):
        rows.append((s, kind, squeeze(_steps(keys[a:b])), squeeze(values[a:b].astype(np.uint64).ravel())))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _PACKED, strict=True)], schema=_PACKED)


def _merge(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed rows of values."""
    k, v = np.concatenate(keys), np.concatenate(values)
    distinct, inverse = np.unique(k, return_inverse=True)
    sums = np.stack([np.bincount(inverse, v[:, i], len(distinct)) for i in range(v.shape[1])], 1)
    return distinct, np.rint(sums).astype(np.int64)


def _count_words(shards: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for _, texts in texts_in(batches, PIECE_BYTES):
            words, _ = streams(texts, hashes)
            keys, counts = np.unique(words, return_counts=True)
            yield _pack_words("uni", keys, counts[:, None], shards)

    return task


def _add_words(table: pa.Table) -> pa.Table:
    """One row per shard of words: its distinct words with counts, and totals."""
    rows = table.select(["shard", "keys", "values"]).to_pylist()
    keys, values = _merge([np.cumsum(spread(r["keys"], np.uint64), dtype=np.uint64) for r in rows],
                          [spread(r["values"], np.uint64)[:, None] for r in rows])
    top = np.argsort(values[:, 0])[-64:]  # a shard has few words with over 1/64 of its tokens
    return pa.table({
        "shard": pa.array([rows[0]["shard"]], pa.int32()), "kind": ["uni"], "keys": pa.array([squeeze(_steps(keys))], pa.binary()),
        "values": pa.array([squeeze(values.astype(np.uint64).ravel())], pa.binary()), "tokens": [int(values.sum())], "distinct": [len(keys)],
        "top": [keys[top].view(np.int64).tolist()], "top_counts": [values[top, 0].tolist()],
    })


def _bigram_shard(first: np.ndarray, second: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    own = chain(first)
    if len(hot):
        own = np.where(np.isin(first, hot), chain(first, second), own)
    return (own % np.uint64(shards)).astype(np.int64)


def _distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one occurrence of each pair, and how often it occurs."""
    key = chain(first, second)
    _, at, counts = np.unique(key, return_index=True, return_counts=True)
    return at, counts


def _count_bigrams(hot: np.ndarray, shards: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for _, texts in texts_in(batches, PIECE_BYTES):
            words, bounds = streams(texts, hashes)
            second = words >> _SHORT
            first = contexts(words, bounds) >> _SHORT
            at, counts = _distinct_pairs(first, second)
            first, second = first[at], second[at]
            shard = _bigram_shard(first, second, hot, shards)
            order = np.lexsort((first, shard))
            first, second, counts, rows = first[order], second[order], counts[order], []
            five = second.view(np.uint8).reshape(-1, 8)[:, :5]
            for s, a, b in _by_shard(shard[order], shards):
                body = b"".join(len(p).to_bytes(4, "little") + p for p in (five[a:b].tobytes(), squeeze(counts[a:b].astype(np.uint32))))
                rows.append((s, "bi", squeeze(_steps(first[a:b])), body))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _PACKED, strict=True)], schema=_PACKED)

    return task


def _read_bigrams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, body = np.cumsum(spread(row["keys"], np.uint64), dtype=np.uint64), row["values"]
    size = int.from_bytes(body[:4], "little")
    second = np.zeros((len(first), 8), np.uint8)
    second[:, :5] = np.frombuffer(body[4 : 4 + size], np.uint8).reshape(-1, 5)
    return first, second.view(np.uint64).ravel(), spread(body[8 + size :], np.uint32)


def _store(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Arrays as files of the shared folder; a second attempt of a task replaces them by equal ones."""
    os.makedirs(folder, exist_ok=True)
    for key, array in arrays.items():
        draft = f"{folder}/.{name}.{key}.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            np.save(out, array)
        os.replace(draft, f"{folder}/{name}.{key}.npy")


def _add_bigrams(folder: str, word_shards: int):
    def group(table: pa.Table) -> pa.Table:
        rows = table.select(["shard", "keys", "values"]).to_pylist()
        first, second, counts = (np.concatenate(x) for x in zip(*map(_read_bigrams, rows), strict=True))
        key, at, inverse = np.unique(chain(first, second), return_index=True, return_inverse=True)
        count = np.rint(np.bincount(inverse, counts, len(key))).astype(np.int64)
        first, second = first[at], second[at]
        many = np.flatnonzero(count >= 255)
        _store(folder, f"bigrams-{rows[0]['shard']}", key=key, count=np.minimum(count, 255).astype(np.uint8),
               many=key[many], many_count=count[many])
        # per context: tokens, and bigrams seen once, twice, more often
        heads, place = np.unique(first, return_inverse=True)
        sums = np.stack([np.bincount(place, w, len(heads)) for w in (count, count == 1, count == 2, count > 2)], 1)
        tails, follows = np.unique(second, return_counts=True)
        sizes = np.array([(count == k).sum() for k in (1, 2, 3, 4)] + [len(count)])
        out = pa.Table.from_batches([_pack_words("ctx", heads, sums, word_shards), _pack_words("cont", tails, follows[:, None], word_shards)])
        return out.append_column("sizes", pa.array([sizes.tolist() if i == 0 else None for i in range(out.num_rows)], pa.list_(pa.int64())))

    return group


def _finish_words(folder: str):
    """Store a shard's words: count, continuations, and the context's tokens and bigrams seen 1, 2, 3+ times."""
    def group(table: pa.Table) -> pa.Table:
        rows = table.select(["shard", "kind", "keys", "values"]).to_pylist()
        held = {}
        for kind, width in (("uni", 1), ("cont", 1), ("ctx", 4)):
            own = [r for r in rows if r["kind"] == kind]
            keys = [np.cumsum(spread(r["keys"], np.uint64), dtype=np.uint64) for r in own] or [np.empty(0, np.uint64)]
            held[kind] = _merge(keys, [spread(r["values"], np.uint64).reshape(-1, width) for r in own] or [np.empty((0, width))])
        keys = held["uni"][0]
        start = np.array([START], np.uint64)
        if len(held["ctx"][0]) and (held["ctx"][0] == (start[0] >> _SHORT)).any():  # a context that is no word
            keys = np.union1d(keys, start)
        values = np.zeros((len(keys), 6), np.int64)
        values[np.isin(keys, held["uni"][0]), 0] = held["uni"][1][:, 0]
        for kind, at in (("cont", 1), ("ctx", 2)):
            k, v = held[kind]
            if len(k):
                place = np.minimum(np.searchsorted(k, keys >> _SHORT), len(k) - 1)
                values[:, at : at + v.shape[1]] = np.where((k[place] == keys >> _SHORT)[:, None], v[place], 0)
        _store(folder, f"words-{rows[0]['shard']}", key=keys, value=values.astype(np.uint64))
        follows = held["cont"][1][:, 0]
        return pa.table({"sizes": pa.array([[int((follows == k).sum()) for k in (1, 2, 3, 4)] + [int(follows.sum())]], pa.list_(pa.int64()))})

    return group


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many entries were seen 1, 2, 3, 4 times."""
    n1, n2, n3, n4 = (max(1, x) for x in n[:4])
    y = n1 / (n1 + 2 * n2)
    clamp = lambda x, k: min(max(x, 0.05), k - 0.05)
    return clamp(1 - 2 * y * n2 / n1, 1), clamp(2 - 3 * y * n3 / n2, 2), clamp(3 - 4 * y * n4 / n3, 3)


class Model:
    """Where the arrays lie, and the few numbers beside them."""

    def __init__(self, folder: str, word_shards: int, bigram_shards: int, hot: list[int], tokens: int, words: int,
                 bigrams: list[int], follows: list[int]):
        self.folder, self.word_shards, self.bigram_shards, self.hot = folder, word_shards, bigram_shards, hot
        self.tokens, self.words, self.bigrams, self.follows = tokens, words, bigrams, follows

    def words_of(self, keys: np.ndarray) -> np.ndarray:
        """Six numbers per sorted distinct word hash."""
        out = np.zeros((len(keys), 6), np.float64)
        shard = ((keys >> _SHORT) % np.uint64(self.word_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for s, a, b in _by_shard(shard[order], self.word_shards):
            at = order[a:b]
            store = _mapped(self.folder, f"words-{s}", "key", "value")
            if store and len(store[0]):
                place = np.minimum(np.searchsorted(store[0], keys[at]), len(store[0]) - 1)
                out[at] = np.where((store[0][place] == keys[at])[:, None], store[1][place], 0)
        return out

    def bigrams_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs of short word names."""
        key, out = chain(first, second), np.zeros(len(first), np.float64)
        shard = _bigram_shard(first, second, np.array(self.hot, np.uint64), self.bigram_shards)
        order = np.lexsort((key, shard))
        for s, a, b in _by_shard(shard[order], self.bigram_shards):
            at = order[a:b]
            store = _mapped(self.folder, f"bigrams-{s}", "key", "count", "many", "many_count")
            if not store:
                continue
            keys, counts, many, many_counts = store
            place = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            found = np.where(keys[place] == key[at], counts[place], 0).astype(np.float64)
            full = np.flatnonzero(found == 255)
            found[full] = many_counts[np.searchsorted(many, key[at][full])]
            out[at] = found
        return out

    def log10(self, count: np.ndarray, context: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """log10 probability from the bigram's count, the context's four numbers and the word's continuations."""
        def off(n, d):
            return np.select([n == 0, n == 1, n == 2], [0.0, d[0], d[1]], d[2])

        low = _discounts(self.follows)
        total = max(1, self.follows[4])
        mass = (low[0] * self.follows[0] + low[1] * self.follows[1] + low[2] * max(0, self.words - sum(self.follows[:2]))) / total
        base = (follows - off(follows, low)) / total + min(1.0, mass) / (self.words + 1)
        high = _discounts(self.bigrams)
        tokens = np.maximum(context[:, 0], 1)
        rest = (context[:, 1:] * high).sum(1) / tokens
        return np.log10(np.where(context[:, 0] > 0, (count - off(count, high)) / tokens + rest * base, base))


@lru_cache(maxsize=512)
def _mapped(folder: str, name: str, *keys: str) -> tuple[np.ndarray, ...] | None:
    if not os.path.exists(f"{folder}/{name}.{keys[0]}.npy"):
        return None
    return tuple(np.load(f"{folder}/{name}.{k}.npy", mmap_mode="r") for k in keys)


def train(texts: DataFrame, workspace: Workspace) -> Model:
    """Count a model over a table with the single column ``text`` (no nulls)."""
    spark = texts.sparkSession
    folder = f"{local_path(workspace.root)}/model-{uuid.uuid4().hex}"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = texts.select(F.lit(0).alias("id"), "text")
    letters = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(least, letters // 6 // SHARD_TOKENS + 1)
    counted = source.mapInArrow(_count_words(shards), _PACKED_SQL)
    words = workspace.freeze(counted.repartition(shards, "shard").groupBy("shard").applyInArrow(
        _add_words, f"{_PACKED_SQL}, tokens long, distinct long, top array<long>, top_counts array<long>"), "words")
    totals = words.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    tokens, distinct = totals["n"] or 0, totals["v"] or 0
    # at most four words a shard can have more than a quarter of a shard's tokens
    tops = words.select(F.explode(F.arrays_zip("top", "top_counts")).alias("t")).select("t.*").filter(F.col("top_counts") * 4 * shards > tokens)
    hot = sorted({(r["top"] % (1 << 64)) >> 24 for r in tops.collect()} | {START >> 24})
    bigrams = source.mapInArrow(_count_bigrams(np.array(hot, np.uint64), shards), _PACKED_SQL)
    derived = workspace.freeze(bigrams.repartition(shards, "shard").groupBy("shard").applyInArrow(
        _add_bigrams(folder, shards), f"{_PACKED_SQL}, sizes array<long>"), "bigrams")
    add = [F.sum(F.element_at("sizes", i + 1)).alias(f"s{i}") for i in range(5)]
    sizes = [x or 0 for x in derived.agg(*add).first()]
    columns = ["shard", "kind", "keys", "values"]
    finished = words.select(columns).unionByName(derived.select(columns)).repartition(shards, "shard").groupBy("shard").applyInArrow(
        _finish_words(folder), "sizes array<long>")
    follows = [x or 0 for x in workspace.freeze(finished, "follows").agg(*add).first()]
    return Model(folder, shards, shards, hot, tokens, distinct, sizes, follows)


def _score(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, hashes = shared.value, Hashes()
        model = Model(**fields)
        for ids, texts in texts_in(batches, PIECE_BYTES):
            words, bounds = streams(texts, hashes)
            before = contexts(words, bounds)
            keys, inverse = np.unique(np.concatenate((words, before)), return_inverse=True)
            known = model.words_of(keys)
            own, prior = known[inverse[: len(words)]], known[inverse[len(words) :]]
            pair, at, place = np.unique(chain(before >> _SHORT, words >> _SHORT), return_index=True, return_inverse=True)
            count = model.bigrams_of((before >> _SHORT)[at], (words >> _SHORT)[at])[place]
            log = model.log10(count, prior[:, 2:], own[:, 1])
            base = np.log10((own[:, 0] + 1) / (model.tokens + model.words + 1))
            add = lambda x: np.add.reduceat(x, bounds[:-1])
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(add((own[:, 0] > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(log))],
                ["id", "n_tokens", "n_known", "base_score", "score"])

    return task


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score, score, perplexity. Null texts are empty: one end token."""
    shared = df.sparkSession.sparkContext.broadcast(dict(vars(model)))
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(_score(shared), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_held_out(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2,
                   workspace: Workspace | None = None) -> DataFrame:
    """Train on rows whose crc32(id) mod ``fold`` is not ``held`` and score all rows.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. A null id is in
    training; repeated rows count as often as they stand there; an empty table gives an empty one; other
    columns are not read.
    """
    store = workspace or Workspace(df.sparkSession)
    source = id_and_text(df, id_col, text_col)
    out = F.coalesce(F.pmod(crc_of("id"), F.lit(fold)) == held, F.lit(False))
    model = train(source.filter(~out).select("text"), store)
    return score_texts(source, model, "id").select(
        F.col("id").alias(id_col), out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity")


def total_mass(model: Model, context: np.ndarray, follows: np.ndarray, counts: np.ndarray) -> float:
    """The probabilities of all known words and one unknown word after a context; 1 up to rounding."""
    none = np.zeros(1)
    all_counts, all_follows = np.concatenate((counts, none)), np.concatenate((follows, none))
    return float(np.sum(10 ** model.log10(all_counts, np.repeat(context[None, :], len(all_counts), 0), all_follows)))
