"""Periodic runs of words by string synchronising sets.

A run of period q is a maximal stretch of words in which words q apart are equal. Runs of ``EXPONENT``
periods or more are found scale by scale, for scales t = 4, 8, 16, ...; scale t finds periods of [t, 2t).

1. Windows of t words get hashes by doubling. A window inside a run of a period up to t / 4 found before is
   *highly periodic* and is never selected; such regions already supplied their small periods.
2. Position i is *synchronising* if, of the windows that start in [i, i + t], the smallest hash that is not
   highly periodic stands at i or at i + t. That depends on the 2t words from i alone, so equal contexts are
   selected alike, and any t positions hold one unless 3t - 1 words have a period of at most t / 4.
3. Two neighbouring synchronising positions with equal contexts of 2t words, q in [t, 2t) apart, propose q.
   A run of period q and 4q words has its first such position within its first t words, and the next one
   exactly q behind it, because 2t > q words recur in a run at multiples of q only.
4. Proposals of one period whose contexts touch are one stretch. A run holds one in every t positions, so a
   stretch lacks less than t words at either end; stretches too short for that go, the rest is compared word by
   word and extended by comparison.

Periods below ``BASE`` are found by comparing the text with itself. Hashes only propose; every run is compared.
All documents of a piece are treated at once; longer ones stay for the larger scales.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidyshelf.llm.common import id_and_text, mix, texts_in

#: A run has so many periods at least, and so many words.
EXPONENT, LEAST = 4, 6
#: Periods below this (a power of two) are found directly.
BASE = 4
#: Bytes of text that are treated together; a longer text is alone.
PIECE_BYTES = 2 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of every stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the stretches, and to which stretch each belongs."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + first[owner], owner


def _lowest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` (a power of two) neighbours from each position on; past the end counts as largest."""
    out, step = hashes, 1
    while step < width:
        ahead = np.full(len(out), ~np.uint64(0))
        ahead[:-step] = out[step:]
        out, step = np.minimum(out, ahead), 2 * step
    return out


def _proposed(doc: np.ndarray, end: np.ndarray, t: int, window: np.ndarray, context: np.ndarray, periodic: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods proposed at scale t; ``window`` and ``context`` are hashes of t and 2t words."""
    top = ~np.uint64(0)
    rank = np.where(periodic, top, window >> np.uint64(1))
    lowest = _lowest(rank, t)
    last = np.full(len(rank), top)
    last[:-t] = rank[t:]
    lowest = np.minimum(lowest, last)
    inside = np.arange(len(doc)) + 2 * t <= end[doc]
    at = np.flatnonzero(inside & (lowest < top) & ((lowest == rank) | (lowest == last)))
    if len(at) < 2:
        return at[:0], at[:0]
    order = np.lexsort((at, context[at], doc[at]))
    at = at[order]
    gap = np.diff(at)
    good = (gap >= t) & (gap < 2 * t) & (context[at[1:]] == context[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    return at[:-1][good], gap[good]


def _confirmed(word: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, t: int, at: np.ndarray,
               period: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) among proposals, compared word by word."""
    order = np.lexsort((at, period, doc[at]))
    at, period = at[order], period[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (period[1:] != period[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (at[1:] > at[:-1] + 2 * t)
    head = np.flatnonzero(fresh)
    low, q = at[head], period[head]
    high = np.maximum.reduceat(at, head) + 2 * t  # words i and i + q are equal for all i of [low, high), says the hash
    long = high - low + 2 * (t - 1) >= (EXPONENT - 1) * q
    low, high, q = low[long], high[long], q[long]
    if not len(low):
        return np.empty((0, 3), np.int64)
    d = doc[low]
    where, owner = _spread(low, high - low)
    true = np.bincount(owner, word[where] != word[where + q[owner]], len(low)) == 0
    # at most t words to the left and to the right
    before = np.minimum(t, low - begin[d])
    where, owner = _spread(low - before, before)
    differ = np.flatnonzero(word[where] != word[where + q[owner]])
    left = low - before
    np.maximum.at(left, owner[differ], where[differ] + 1)
    behind = np.minimum(t, end[d] - q - high)
    where, owner = _spread(high, behind)
    differ = np.flatnonzero(word[where] != word[where + q[owner]])
    right = high + behind
    np.minimum.at(right, owner[differ], where[differ])
    true &= right - left >= (EXPONENT - 1) * q
    return np.unique(np.stack((left, right - left + q, q), 1)[true], axis=0)


def find_runs(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (document, start within it, length, period) of all runs of documents laid end to end, in that order.

    ``word`` has one number per word, ``sizes`` the words of each document.
    """
    word, sizes = np.asarray(word, np.int64), np.asarray(sizes, np.int64)
    whole_begin = np.cumsum(sizes) - sizes
    runs = [np.empty((0, 3), np.int64)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for q in range(1, min(BASE, len(word))):
        low, high = _stretches((word[q:] == word[:-q]) & (doc[q:] == doc[:-q]))
        good = high - low >= (EXPONENT - 1) * q
        found = np.stack((low, high - low + q, np.full(len(low), q)), 1)[good]
        # a multiple of a smaller period is none of its own: its stretch is that period's run
        spans = np.concatenate(runs)[:, :2] @ [len(word) + 1, 1]
        found = found[~np.isin(found[:, :2] @ [len(word) + 1, 1], spans)]
        runs.append(found)

    t, own = 1, mix((word.astype(np.uint64) + np.uint64(1)) * _STEP)
    kept = np.arange(len(word))
    begin, end = whole_begin, whole_begin + sizes
    while len(kept):
        behind = np.zeros(len(own), np.uint64)
        behind[:-t] = own[t:]
        context = mix(own * _STEP ^ mix(behind + _STEP))
        if t >= BASE:
            known = np.concatenate(runs)
            inner = known[(known[:, 2] * 4 <= t) & (known[:, 1] >= t)]
            mark = np.zeros(len(word) + 1, np.int32)  # in numbers of the whole piece
            np.add.at(mark, inner[:, 0], 1)
            np.add.at(mark, inner[:, 0] + inner[:, 1] - t + 1, -1)
            periodic = np.cumsum(mark)[kept] > 0
            at, q = _proposed(doc, end, t, own, context, periodic)
            if len(at):
                found = _confirmed(word[kept], doc, begin, end, t, at, q)
                found[:, 0] = kept[found[:, 0]]
                runs.append(found)
        # the next scale wants documents of EXPONENT * 2t words at least
        t, own = 2 * t, context
        if t >= BASE:
            stay = (end - begin >= EXPONENT * t)[doc]
            kept, own, doc = kept[stay], own[stay], doc[stay]
            _, doc, left = np.unique(doc, return_inverse=True, return_counts=True)
            end = np.cumsum(left)
            begin = end - left
    runs = np.concatenate(runs)
    runs = runs[runs[:, 1] >= LEAST]
    of = np.searchsorted(whole_begin + sizes, runs[:, 0], side="right")
    out = np.column_stack((of, runs[:, 0] - whole_begin[of], runs[:, 1:]))
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def planted_period(doc_id: int, n: int) -> tuple[int, int] | None:
    """First word and period with which the id's checksum makes a text of n words periodic, if it does."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _report(planted: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in texts_in(batches, PIECE_BYTES):
            numbers, words, number, sizes = defaultdict(count().__next__), [], [], []
            for i, text in zip(ids.to_pylist(), texts, strict=True):
                own = text.encode().split()  # at \x20 and \x09-\x0d alone
                if planted and i is not None and (at := planted_period(i, len(own))):
                    a, p = at
                    n = len(own) - a
                    own = own[:a] + (own[a : a + p] * (n // p + 1))[:n]
                words.append(own)
                sizes.append(len(own))
                number.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
            found = find_runs(np.concatenate(number), np.array(sizes))
            cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).tolist()
            rows = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for i, own in enumerate(words):
                runs = found[cuts[i] : cuts[i + 1], 1:].tolist()
                keep = np.ones(len(own), bool)
                for start, length, period in runs:
                    keep[start + period : start + length] = False
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=[None] * 3)
                rows["n_runs"].append(len(runs))
                for name, value in zip(("start", "length", "period"), best, strict=True):
                    rows[name].append(value)
                rows["exponent_milli"].append(1000 * best[1] // best[2] if runs else None)
                rows["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest())
                left = b" ".join(compress(own, keep.tolist()) if runs else own)
                rows["collapsed_sha256"].append(hashlib.sha256(left).hexdigest())
            columns = [pa.array(v, pa.string() if c.endswith("sha256") else pa.int64()) for c, v in rows.items()]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", *rows])

    return task


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """Per row: id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Words are what ASCII white space separates. A word is dropped from the collapsed text if a run holds it
    after its first period. ``planted`` first makes texts periodic whose (integer) id says so; a null id
    says nothing. Null, empty and blank texts have no word and no run. Rows are treated one by one: repeated
    rows and ids give repeated results, an empty table an empty one; other columns are not read.
    """
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_report(planted), f"id {kind}, n_runs long, start long, length long, period long, "
                             "exponent_milli long, runs_sha256 string, collapsed_sha256 string").withColumnRenamed("id", id_col)
