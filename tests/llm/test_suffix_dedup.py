import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm import suffix_dedup
from tidyshelf.llm.common import table
from tidyshelf.llm.suffix_dedup import measure_repeats, remove_repeats


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, digest) by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def check(df, rows, length=200):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in measure_repeats(df, length=length).collect()), key=str)
    expected = sorted(((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows], length), strict=True)), key=str)
    assert got == expected
    return expected


def test_given_table(spark):
    docs = table(spark, SF, "documents")
    assert sum(r[2] for r in check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])) > 0


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed, monkeypatch):
    """Shared passages of all lengths around the limit, shifted, overlapping, periodic, over small packs."""
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 3000)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (30, 45, 60, 60, 120)] + ["ab" * 160, "x" * 260, prose(4) * 30]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 40)
            parts += [p[a : len(p) - rng.randrange(0, 40)], prose(rng.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[5][1]), (101, passages[2]), (102, passages[2][:-1]), (103, "z" + passages[2])]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_common_passage_behind_own_words(spark, monkeypatch):
    """Every end of a match has one core; its windows still spread over the shards, and each is judged."""
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 3000)
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage, leads = prose(320), [prose(150) for _ in range(4)]
    rows = [(i, prose(90) + (leads[i % 4][i % 7 :] if i % 3 == 0 else "") + passage[i % 5 :] + prose(90)) for i in range(80)]
    rows += [(100 + i, passage) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (0, 5, 8192):
        monkeypatch.setattr(suffix_dedup, "HOT_ENDS", hot)
        check(df, rows)


def test_hot_core_is_split():
    rng = random.Random(3)
    prose = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    passage = prose(400)
    texts = [prose(300) + passage + prose(300) for _ in range(200)]
    buffer, starts = np.frombuffer(b"".join(texts), np.uint8), np.arange(201) * 1000
    parse = suffix_dedup.Parse(buffer, starts, 1)
    core, times = np.unique(parse.core, return_counts=True)
    states = np.where(parse.core == core[times.argmax()], suffix_dedup._HOT_END, 0)
    assert times.max() >= 200
    ends = suffix_dedup._ends(buffer, parse, states, 8, 50)
    sent = np.bincount(ends.shard, minlength=8)
    assert sent.max() < 2 * sent.sum() / 8 and len(set(buffer[a : a + 200].tobytes() for a in ends.low)) == len(ends.low)


def answered(texts, length, block):
    """One shard's verdict on all windows of the texts."""
    table = pa.table({
        "shard": pa.array([0], pa.int32()), "part": pa.array([0], pa.int64()),
        "bodies": [zstandard.ZstdCompressor().compress(b"".join(texts))],
        "sizes": [np.array([(len(t) - length + 1) << 1 for t in texts], np.uint16).tobytes()]})
    n = sum(len(t) - length + 1 for t in texts)
    return np.unpackbits(np.frombuffer(suffix_dedup._answer_ends(length, block)(table)["answer"][0].as_py(), np.uint8), count=n).astype(bool)


@pytest.mark.parametrize("block", [3, 100_000])
def test_runs_longer_than_a_block(block):
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(8, 40))) for _ in range(60)] + [b"x" * 50, b"x" * 9]
    windows = [t[i : i + 8] for t in texts for i in range(len(t) - 7)]
    seen = Counter(windows)
    assert answered(texts, 8, block).tolist() == [seen[w] > 1 for w in windows]


def test_last_run_starts_before_the_last_block():
    assert answered([b"x" * 30_000] * 5, 200, suffix_dedup.BLOCK).all()


def test_equal_hashes_of_different_bytes():
    at = np.array([0, 2, 4, 6, 8])
    assert suffix_dedup._first_equal(np.frombuffer(b"abcdabefcd", np.uint8), at, np.zeros(5, np.int64), 2, 2).tolist() == [0, 1, 0, 3, 1]


def test_odd_texts(spark, odd, empty):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD_TEXTS)]
    check(odd, rows)
    assert measure_repeats(empty).count() == 0
    clean = remove_repeats(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD_TEXTS)
    assert remove_repeats(empty).count() == 0
    assert sorted(len(r["text"]) for r in clean.collect())[-1] < 200


@pytest.mark.parametrize("size", [0, 10, 16, suffix_dedup.STRIDE - 1, suffix_dedup.STRIDE, suffix_dedup.STRIDE + 15, 2 * suffix_dedup.STRIDE + 100])
def test_triggers_found_by_strides_are_those_of_single_hashes(size):
    buffer = np.random.default_rng(size).integers(0, 4, size, dtype=np.uint8)
    rolling, n = suffix_dedup.Rolling(buffer, 350), size - 16 + 1
    at = np.arange(max(0, n))
    assert rolling.starts_below(1 << 60, 16, n).tolist() == np.flatnonzero(rolling.of(at, at + 16) < np.uint64(1 << 60)).tolist()


def test_a_pack_takes_little_memory_beside_its_prefix_sums():
    """Sums are 8 bytes for each of the buffer; triggers are sought without further arrays of that length."""
    buffer = np.random.default_rng(1).integers(0, 256, suffix_dedup.PACK_BYTES, dtype=np.uint8)
    suffix_dedup.Parse(buffer[:1000], np.array([0, 1000]), 4)
    tracemalloc.start()
    suffix_dedup.Parse(buffer, np.array([0, len(buffer) // 2, len(buffer)]), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(buffer)
