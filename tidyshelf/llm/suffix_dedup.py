"""Removal of repeated strings by prefix-free parsing.

Every window of ``LENGTH`` bytes that starts at two or more places is repeated; the bytes it covers go.
A rolling hash picks triggers; phrases run from trigger to trigger, so equal strings are parsed equally.

1. Dictionary. A phrase with the ``LENGTH`` bytes behind its last start is one entry. If the entry occurs
   twice, all windows that start in the phrase are repeated, and nothing more has to be known about it.
   Long gaps without a trigger are parsed into single windows.
2. Parse. An entry that occurs once can only hold repeated windows if the core behind its closing trigger
   occurs elsewhere. Only these entries, the ends of matches, are looked at byte by byte, each with one
   example of every repeated entry that has the same core.
3. Windows. The windows of such entries are brought together by hash and compared on ``LENGTH`` bytes;
   equal ones are repeated. Entries meet by core; where a core has more than ``HOT_ENDS`` of them, each
   distinct window of a pack goes by its own hash instead, so that no core fills a task.

Texts travel in packs. A pack sends its distinct entries (two 64-bit hashes) to shards by core, and gets
what is known of each back; ends of matches are sent and answered in the same way. Shards are as many as
keep one within ``SHARD_ENTRIES``, and a string repeated within a pack is sent once. Step 3 compares
bytes; steps 1 and 2 trust 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import chain, give_back, mix, text_of
from tidyshelf.llm.packs import answers_by_part, pack, unpack
from tidyshelf.storage import Workspace

LENGTH = 200
#: A trigger is a window of so many bytes; one in RARITY is chosen.
TRIGGER, RARITY = 16, 32
#: A start this far before the next trigger at most belongs to it; the core fills the rest of LENGTH.
REACH = 150
PACK_BYTES = 2 << 20
SHARD_ENTRIES = 2_000_000
#: Bytes of context that one task compares.
SHARD_BYTES = 4 << 20
#: Bytes after which prefix sums begin anew (a power of two).
STRIDE = 1 << 16
#: Ends of matches and examples of one core that may meet in one task.
HOT_ENDS = 8_192
#: Windows whose bytes are laid out and compared at once.
BLOCK = 100_000

#: The last two are ends and examples of a core that has very many.
_UNKNOWN, _REPEATED, _END, _EXAMPLE, _HOT_END, _HOT_EXAMPLE = range(6)
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    both = [np.full(n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    for powers in both:
        powers[0] = 1
        np.cumprod(powers, out=powers)
    return both[0], both[1]


class Rolling:
    """Hashes of any stretches of up to ``longest`` bytes from prefix sums.

    Sums begin anew every ``STRIDE`` bytes and reach ``longest`` bytes beyond, so the table of powers stays short.
    """

    def __init__(self, buffer: np.ndarray, longest: int):
        self.width = STRIDE + longest + 1
        power, self.inverse = _power(self.width)
        blocks = len(buffer) // STRIDE + 1
        self.sums = np.zeros((blocks, self.width), np.uint64)
        for k in range(blocks):
            piece = buffer[k * STRIDE : k * STRIDE + self.width - 1]
            np.cumsum(_bytes_table()[piece] * power[: len(piece)], out=self.sums[k, 1 : len(piece) + 1])
        self.sums = self.sums.ravel()

    def starts_below(self, limit: int, length: int, size: int) -> np.ndarray:
        """The starts below ``size`` of stretches of ``length`` bytes with hashes below a limit, one stride at a time."""
        found = []
        for k, sums in enumerate(self.sums.reshape(-1, self.width)):
            n = min(STRIDE, size - k * STRIDE)
            if n > 0:
                hashes = mix((sums[length : length + n] - sums[:n]) * self.inverse[:n])
                found.append(k * STRIDE + np.flatnonzero(hashes < np.uint64(limit)))
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        block, place = np.divmod(start, STRIDE)
        at = block * self.width + place
        return mix((self.sums[at + (end - start)] - self.sums[at]) * self.inverse[place])


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of [first, last], and to which range each belongs."""
    n = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    begin = np.concatenate(([0], np.cumsum(n)))[:-1]
    return np.arange(len(owner)) - begin[owner] + first[owner], owner


class Parse:
    """The entries of a buffer of documents: distinct ones, in the order in which they are sent."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, shards: int, length: int = LENGTH):
        reach, self.length = min(REACH, length * 3 // 4), length
        trigger = min(TRIGGER, length - reach)
        rolling = Rolling(buffer, length + reach)
        size = len(buffer)
        chosen = rolling.starts_below((1 << 64) // RARITY, trigger, size - trigger + 1)
        doc = np.searchsorted(starts, chosen, side="right") - 1
        begin, end = starts[:-1], starts[1:]
        inside = chosen + trigger <= end[doc]
        chosen, doc = chosen[inside], doc[inside]
        # starts before each trigger, and after the last one of each document
        previous = np.concatenate(([-1], chosen[:-1])) if len(chosen) else chosen
        previous = np.maximum(previous, begin[doc])
        top = end[doc] - length
        low, high = np.maximum(previous, chosen - reach), np.minimum(chosen - 1, top)
        last = begin.copy()
        np.maximum.at(last, doc, chosen)
        gaps, _ = _ranges(np.concatenate((previous, last)), np.concatenate((np.minimum(chosen - reach - 1, top), end - length)))
        real = low <= high
        low, high, core_at = low[real], high[real], chosen[real]
        core = rolling.of(core_at, core_at + (length - reach))
        entry = chain(rolling.of(low, high + length), (core_at - low).astype(np.uint64), (high - low).astype(np.uint64))
        gap = chain(rolling.of(gaps, gaps + length), np.full(len(gaps), 3, np.uint64))
        self.low, self.high = np.concatenate((low, gaps)), np.concatenate((high, gaps))
        core, entry = np.concatenate((core, gap)), np.concatenate((entry, gap)) & ~np.uint64(1)
        distinct, first, self.inverse, counts = np.unique(entry, return_index=True, return_inverse=True, return_counts=True)
        shard = (core[first] % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((distinct, core[first], shard))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.inverse = place[self.inverse]
        self.first, self.core, self.shard = first[order], core[first][order], shard[order]
        self.entry = distinct[order] | (counts[order] > 1).astype(np.uint64)


def _buffer(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    texts = [t.encode() for t in batch.column(column).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _send_entries(column: str, shards: int, length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parse = Parse(*_buffer(unpack(body), column), shards, length)
                cuts = np.searchsorted(parse.shard, np.arange(shards + 1))
                held = np.flatnonzero(np.diff(cuts)).tolist()
                cores, entries = [], []
                for s in held:
                    a, b = cuts[s], cuts[s + 1]
                    steps = np.diff(parse.core[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
                    cores.append(squeeze.compress(steps))
                    entries.append(parse.entry[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(held, pa.int32()), pa.array([part] * len(held), pa.int64()), pa.array(cores, pa.binary()),
                    pa.array(entries, pa.binary())], ["shard", "part", "cores", "entries"])
        give_back()

    return task


def _answer_entries(hot_ends: int):
    def group(table: pa.Table) -> pa.Table:
        return _known_of_entries(table, hot_ends)

    return group


def _known_of_entries(table: pa.Table, hot_ends: int) -> pa.Table:
    """What is known of each entry, and how many are ends of matches or examples."""
    squeeze, unpack_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    rows = table.select(["shard", "part", "cores", "entries"]).to_pylist()
    rows.sort(key=lambda r: r["part"])
    core = np.concatenate([np.cumsum(np.frombuffer(unpack_.decompress(r["cores"]), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64) for r in rows])
    entries = [np.frombuffer(r["entries"], np.uint64) for r in rows]
    sizes, entry = [len(e) for e in entries], np.concatenate(entries)
    times = 1 + (entry & np.uint64(1)).astype(np.int64)
    entry &= ~np.uint64(1)
    _, first, inverse = np.unique(entry, return_index=True, return_inverse=True)
    repeated = np.bincount(inverse, times)[inverse] > 1
    _, group = np.unique(core, return_inverse=True)
    shared = np.bincount(group, times)[group] > 1
    has_end = np.bincount(group, ~repeated)[group] > 0
    state = np.where(repeated, _REPEATED, np.where(shared, _END, _UNKNOWN)).astype(np.uint8)
    first = first[repeated[first] & has_end[first]]
    state[first] = _EXAMPLE
    state[(state >= _END) & (np.bincount(group, state >= _END)[group] > hot_ends)] += _HOT_END - _END
    parts = np.split(state, np.cumsum(sizes)[:-1])
    return pa.table({
        "part": pa.array([r["part"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int32()),
        "answer": pa.array([squeeze.compress(p.tobytes()) for p in parts], pa.binary()),
        "ends": pa.array([int(((p == _END) | (p == _EXAMPLE)).sum()) for p in parts], pa.int64()),
        "hot": pa.array([int((p >= _HOT_END).sum()) for p in parts], pa.int64()),
    })


def _first_equal(buffer: np.ndarray, at: np.ndarray, number: np.ndarray, length: int, block: int) -> np.ndarray:
    """For each window, the first one with the same bytes; windows with different ``number`` differ.

    Each is compared with the first of its number, ``block`` at a time; those that differ from it go again.
    """
    first, left = np.arange(len(at)), np.arange(len(at))
    strings = np.lib.stride_tricks.sliding_window_view(buffer, length) if len(at) else None
    while len(left):
        _, lead, run = np.unique(number[left], return_index=True, return_inverse=True)
        lead = left[lead][run]
        same = np.concatenate([
            (strings[at[left[i : i + block]]] == strings[at[lead[i : i + block]]]).all(1) for i in range(0, len(left), block)])
        first[left[same]] = lead[same]
        left = left[~same]
    return first


def _states(answers: list[bytes] | None) -> np.ndarray:
    decompress = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(b"".join(decompress(a) for a in answers or []), np.uint8)


@dataclass
class Ends:
    """Pieces of a buffer to be looked at byte by byte, in the order in which they are sent: first and last window,
    whether the windows are known to repeat, and shard; then places that may be repeated, and the windows that tell."""

    low: np.ndarray
    high: np.ndarray
    known: np.ndarray
    shard: np.ndarray
    place: np.ndarray
    window: np.ndarray


def _ends(buffer: np.ndarray, parse: Parse, states: np.ndarray, shards: int, block: int) -> Ends:
    length = parse.length
    found = np.flatnonzero((states == _END) | (states == _EXAMPLE))
    at = parse.first[found]
    low, high, known = parse.low[at], parse.high[at], states[found] == _EXAMPLE
    key = mix(parse.core[found])
    hot = np.flatnonzero(states >= _HOT_END)
    places, owner = _ranges(parse.low[parse.first[hot]], parse.high[parse.first[hot]])
    piece = np.zeros(0, np.int64)
    if len(hot):  # single windows, each distinct one once
        number = Rolling(buffer, length).of(places, places + length)
        lead, piece, times = np.unique(_first_equal(buffer, places, number, length, block), return_inverse=True, return_counts=True)
        sure = np.bincount(piece, states[hot][owner] == _HOT_EXAMPLE) > 0
        low, high, known = np.concatenate((low, places[lead])), np.concatenate((high, places[lead])), np.concatenate((known, sure | (times > 1)))
        key = np.concatenate((key, number[lead]))
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    begin = np.concatenate(([0], np.cumsum((high - low + 1)[order])))[:-1]
    cold = np.flatnonzero(states[found] == _END)
    own, of = _ranges(low[cold], high[cold])
    mine = states[hot][owner] == _HOT_END
    place = np.concatenate((own, places[mine]))
    window = np.concatenate((begin[rank[cold]][of] + own - low[cold][of], begin[rank[len(found) + piece[mine]]]))
    return Ends(low[order], high[order], known[order], shard[order], place, window)


def _send_ends(column: str, shards: int, end_shards: int, length: int, block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, body, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buffer, starts = _buffer(unpack(body), column)
                parse, states = Parse(buffer, starts, shards, length), _states(answers)
                ends = _ends(buffer, parse, states, end_shards, block)
                cuts = np.searchsorted(ends.shard, np.arange(end_shards + 1))
                held = np.flatnonzero(np.diff(cuts)).tolist()
                bodies, sizes = [], []
                for s in held:
                    low, high, known = (x[cuts[s] : cuts[s + 1]] for x in (ends.low, ends.high, ends.known))
                    where, _ = _ranges(low, high + length - 1)
                    bodies.append(squeeze.compress(buffer[where].tobytes()))
                    sizes.append((((high - low + 1) << 1) | known).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(held, pa.int32()), pa.array([part] * len(held), pa.int64()), pa.array(bodies, pa.binary()),
                    pa.array(sizes, pa.binary())], ["shard", "part", "bodies", "sizes"])
        give_back()

    return task


def _answer_ends(length: int, block: int):
    def group(table: pa.Table) -> pa.Table:
        unpack_ = zstandard.ZstdDecompressor()
        rows = table.select(["shard", "part", "bodies", "sizes"]).to_pylist()
        buffer = np.frombuffer(b"".join(unpack_.decompress(r["bodies"]) for r in rows), np.uint8)
        packed = [np.frombuffer(r["sizes"], np.uint16).astype(np.int64) for r in rows]
        size = np.concatenate(packed)
        weight, windows = 1 + (size & 1), size >> 1
        begin = np.concatenate(([0], np.cumsum(windows + length - 1)))[:-1]
        at, owner = _ranges(begin, begin + windows - 1)
        _, inverse = np.unique(Rolling(buffer, length).of(at, at + length), return_inverse=True)
        likely = np.flatnonzero(np.bincount(inverse, weight[owner])[inverse] > 1)
        repeated = np.zeros(len(at), bool)
        first = _first_equal(buffer, at[likely], inverse[likely], length, block)
        repeated[likely] = np.bincount(first, weight[owner[likely]], len(likely))[first] > 1
        ends = np.cumsum([int((p >> 1).sum()) for p in packed])
        masks = np.split(repeated, ends[:-1])
        return pa.table({
            "part": pa.array([r["part"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int32()),
            "answer": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()),
        })

    return group


def _finish(column: str, shards: int, end_shards: int, length: int, block: int, names: list[str], with_text: bool, with_digest: bool):
    def covered(buffer: np.ndarray, parse: Parse, states: np.ndarray, masks: list[bytes]) -> np.ndarray:
        steps = np.zeros(len(buffer) + 1, np.int32)
        whole = np.flatnonzero(np.isin(states, (_REPEATED, _EXAMPLE, _HOT_EXAMPLE))[parse.inverse])
        np.add.at(steps, parse.low[whole], 1)
        np.add.at(steps, parse.high[whole] + length, -1)
        ends = _ends(buffer, parse, states, end_shards, block)
        if len(ends.shard):
            _, owner = np.unique(ends.shard, return_inverse=True)
            counts = np.bincount(owner, ends.high - ends.low + 1).astype(np.int64).tolist()
            bits = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(masks, counts, strict=True)])
            hit = ends.place[bits[ends.window] == 1]
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + length, -1)
        return np.cumsum(steps[:-1], out=steps[:-1]) > 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, answers, masks in zip(*(batch.column(c).to_pylist() for c in ("body", "answers", "masks")), strict=True):
                rows = unpack(body)
                buffer, starts = _buffer(rows, column)
                gone = covered(buffer, Parse(buffer, starts, shards, length), _states(answers), masks or [])
                rising = gone & ~np.concatenate(([False], gone[:-1]))
                rising[starts[:-1][starts[:-1] < len(buffer)]] |= gone[starts[:-1][starts[:-1] < len(buffer)]]
                removed, spans = (np.concatenate(([0], np.cumsum(x)))[starts] for x in (gone, rising))
                kept = buffer[~gone].tobytes()
                left = starts - removed
                texts = [kept[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                if with_text:
                    whole = [t.decode(errors="ignore") for t in texts]
                    rows = rows.set_column(rows.schema.get_field_index(column), column, pa.array(whole, pa.string()))
                columns = [rows.column(n) for n in names]
                added = []
                if with_digest:
                    columns += [pa.array(np.diff(starts)), pa.array(np.diff(removed)), pa.array(np.diff(spans)),
                                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])
        give_back()

    return task


def _deduplicated(rows: DataFrame, column: str, names: list[str], with_text: bool, with_digest: bool, length: int, workspace: Workspace | None) -> DataFrame:
    spark = rows.sparkSession
    store = workspace or Workspace(spark)
    packs = store.freeze(pack(rows, column, PACK_BYTES), "packs")
    bytes_in = packs.count() * PACK_BYTES
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, bytes_in // RARITY * 3 // 2 // SHARD_ENTRIES + 1)
    sent = packs.mapInArrow(_send_entries(column, shards, length), "shard int, part long, cores binary, entries binary")
    states = store.freeze(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(
        _answer_entries(HOT_ENDS), "part long, shard int, answer binary, ends long, hot long"), "states")
    ends, hot = (n or 0 for n in states.agg(F.sum("ends"), F.sum("hot")).first())
    end_shards = max(least, (ends * (length + RARITY) + hot * RARITY * length) // SHARD_BYTES + 1)
    known = packs.join(answers_by_part(states), "part", "left")
    ends_sent = known.select("part", "body", "answers").mapInArrow(
        _send_ends(column, shards, end_shards, length, BLOCK), "shard int, part long, bodies binary, sizes binary")
    masks = store.freeze(ends_sent.repartition(end_shards, "shard").groupBy("shard").applyInArrow(
        _answer_ends(length, BLOCK), "part long, shard int, answer binary"), "masks")
    both = known.join(answers_by_part(masks).withColumnRenamed("answers", "masks"), "part", "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + (", n_bytes long, n_removed long, n_spans long, kept_sha256 string" if with_digest else "")
    return both.mapInArrow(_finish(column, shards, end_shards, length, BLOCK, names, with_text, with_digest), schema)


def measure_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, length: int = LENGTH,
                    workspace: Workspace | None = None) -> DataFrame:
    """Per row: id, (clean text,) n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts are empty; matches never cross rows; repeated rows remove each other, null ids
    or not. An empty table gives an empty one; other columns are not read. The digest is of the kept
    bytes; the clean text leaves out a character of which only a part is kept.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    out = _deduplicated(rows, "text", ["id", "text"] if with_text else ["id"], with_text, True, length, workspace)
    return out.withColumnRenamed("id", id_col)


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, workspace: Workspace | None = None) -> DataFrame:
    """All rows and columns of ``df``, the texts without repeated strings; null texts come back empty."""
    rows = df.withColumn(text_col, text_of(text_col))
    return _deduplicated(rows, text_col, list(df.columns), True, False, length, workspace)
