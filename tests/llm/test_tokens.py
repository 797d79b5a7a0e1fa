import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm.common import table
from tidyshelf.llm.packing import best_fit, pack_documents
from tidyshelf.llm.token_counts import count_tokens, cut
from tidyshelf.llm.tokens import TAME, PieceLengths, Units, load_json
from tests.conftest import SF

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, odd, empty):
    rows = count_tokens(odd, BYTES, limit=3, table_size=4).collect()
    expected = [len(ids(BYTES, t)) for t in ODD_TEXTS]
    assert sorted(r["n_tokens"] for r in rows) == sorted(expected)
    assert sorted(r["n_bytes"] for r in rows) == sorted(len((t or "").encode()) for t in ODD_TEXTS)
    assert sum(r["over_limit"] for r in rows) == sum(n > 3 for n in expected)
    assert count_tokens(empty, BYTES).count() == 0
    docs = table(spark, SF, "documents")
    library = Tokenizer.from_file(BYTES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in count_tokens(docs, BYTES).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sSé1²½.,!- \n\t\x1c ǅƻ|<>"), max_size=40))
def test_pieces_are_independent(text):
    pieces = cut(text, ("<|endoftext|>",))
    if pieces is not None:
        whole = Tokenizer.from_file(BYTES) if not hasattr(test_pieces_are_independent, "t") else test_pieces_are_independent.t
        test_pieces_are_independent.t = whole
        split = [pieces[0], *(f" {p}" for p in pieces[1:])]
        assert sum((whole.encode(p, add_special_tokens=False).ids for p in split), []) == whole.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew():
    asked = []

    def measure(pieces):
        asked.extend(pieces)
        return list(map(len, pieces))

    lengths = PieceLengths(measure, {"aa": 2}, room=3)
    for texts in (["aa bbb c", ""], ["c dddd aa"], ["bbb e ff g hhhhh", "aa"], ["c bbb aa hhhhh"]):
        lists = [t.split() for t in texts]
        assert lengths.sums(lists).tolist() == [sum(map(len, x)) for x in lists]
    assert "aa" not in asked and asked.count("c") == 2


def same_ids(units, texts):
    flat, sizes = units(texts)
    library = Tokenizer.from_file(WORDS)
    ends = np.cumsum(sizes).tolist()
    return [flat[a:b].tolist() for a, b in zip([0, *ends], ends)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_of_every_tame_character():
    """Each character between letters, digits, symbols and blanks, as the library sees it."""
    units = Units(load_json(WORDS))
    assert units.fits and same_ids(units, [f"a{c}b {c} 1{c}2 .{c}. {c}{c}'s" for c in map(chr, range(1, ord(TAME) + 40))])
    assert not Units(load_json(BYTES)).fits


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sStTvVE1²½.,!- \n\t\x1c\xa0éÉİßǅ\u0301漢<|endoftext|>"), max_size=30), max_size=5))
def test_units_equal_the_library(texts):
    units = getattr(test_units_equal_the_library, "units", None) or Units(load_json(WORDS), room=40)
    test_units_equal_the_library.units = units
    assert same_ids(units, texts) and len(units.numbers) <= max(40, sum(map(len, texts)))


class Reader:
    """A pattern that notes how many characters it reads."""

    def __init__(self, pattern):
        self.pattern, self.read = pattern, 0

    def findall(self, text):
        self.read += len(text)
        return self.pattern.findall(text)


def test_repeated_stretches_are_cut_into_units_once():
    """Between blanks a piece of texts has few distinct stretches; units are sought in these alone, not in every text."""
    texts = ["Some words, it's so:\tcome 12 times.\n" * 400, "", " Words, it's\xa0so 400 ", "\u6f22 some"] * 3
    units = Units(load_json(WORDS))
    units.units = reader = Reader(units.units)
    assert same_ids(units, texts) and same_ids(units, [""]) and 0 < reader.read < 300


def test_units_bear_no_texts():
    ids, sizes = Units(load_json(WORDS))([])
    assert len(ids) == len(sizes) == 0


def test_best_fit_takes_the_tightest_window():
    numbers, offsets = best_fit([6, 5, 4, 3, 2], 10)
    assert numbers == [0, 1, 0, 1, 1] and offsets == [0, 0, 6, 5, 8]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80))
def test_best_fit_equals_a_plain_search(lengths):
    lengths = sorted(lengths, reverse=True)
    room, plain = [], []
    for n in lengths:
        fits = sorted((r, i) for i, r in enumerate(room) if r >= n)
        if not fits:
            room.append(64)
            fits = [(64, len(room) - 1)]
        room[fits[0][1]] -= n
        plain.append(fits[0][0] - n)
    numbers, offsets = best_fit(lengths, 64)
    assert [64 - o - n for o, n in zip(offsets, lengths, strict=True)] == plain
    assert max(numbers, default=-1) + 1 == len(room)


def check_packed(rows, streams, window):
    """Every id in one piece, gapless windows, right digests."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for doc, stream in streams.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(stream)
            assert r["ids_crc32"] == zlib.crc32(np.array(stream[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(stream)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return sum(window - sum(r["length"] for r in own) for own in windows.values()) / max(1, window * len(windows))


def test_packing(spark, odd, empty):
    library = Tokenizer.from_file(WORDS)
    docs = table(spark, SF, "documents")
    streams = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert check_packed(pack_documents(docs, WORDS).collect(), streams, 4096) < 0.02
    numbered = odd.selectExpr("n_tokens AS doc_id", "text", "score AS start")
    odd_streams = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(ODD_TEXTS)}
    check_packed(pack_documents(numbered, WORDS, window=64).collect(), odd_streams, 64)
    kept = pack_documents(numbered, WORDS, keep_ids=True).collect()
    assert sorted(x for r in kept for x in r["ids"]) == sorted(x for s in odd_streams.values() for x in s)
    assert pack_documents(odd, WORDS).count() == len(ODD_TEXTS)  # null and repeated ids
    assert pack_documents(empty, WORDS).count() == 0
