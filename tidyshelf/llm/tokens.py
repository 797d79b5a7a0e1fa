"""Token ids of whole texts through caches of their pieces."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that one worker keeps before it starts anew.
CACHE_ROOM = 400_000
#: Texts may use this fast path only if all their code points lie below: Latin scripts, for which the
#: definition of letters, digits and white space is the same in Python and in the library.
TAME = "ɐ"


@lru_cache(maxsize=4)
def load_json(path: str):
    """A tokenizer of the ``tokenizers`` library, one per worker and file, single-threaded in a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_ids(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceLengths:
    """Token counts of pieces in two tiers: a fixed table, then a bounded cache of what ``measure`` said of others.

    Pieces are numbered by one dictionary, and their counts gathered by array operations. A full cache starts
    anew with the table and the pieces at hand.
    """

    def __init__(self, measure, table: dict[str, int] | None = None, room: int = CACHE_ROOM):
        self.measure, self.table, self.room = measure, table or {}, room
        self._empty()

    def _empty(self) -> None:
        self.numbers = dict(zip(self.table, range(len(self.table)), strict=True))
        self.size = np.fromiter(self.table.values(), np.int64, len(self.table))

    def sums(self, lists: list[list[str]]) -> np.ndarray:
        """The counts of each list's pieces, added up."""
        numbers = self.numbers
        fresh = [p for p in set(chain.from_iterable(lists)) if p not in numbers]
        if fresh and len(numbers) + len(fresh) > self.room + len(self.table):
            self._empty()
            numbers = self.numbers
            fresh = [p for p in set(chain.from_iterable(lists)) if p not in numbers]
        if fresh:
            new = [n for at in range(0, len(fresh), 4096) for n in self.measure(fresh[at : at + 4096])]
            numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh)), strict=True))
            self.size = np.concatenate((self.size, np.array(new, np.int64)))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        total = np.concatenate(([0], np.cumsum(self.size[at])))
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


#: Units that one worker keeps, and those whose ids are asked for in one text.
UNIT_ROOM, UNITS_TOGETHER = 200_000, 256
#: What ``Units`` relies on (fixed values: the normalizer and pattern of the tokenizers it serves).
UNIT_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
UNIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _unit_pattern() -> re.Pattern:
    """``UNIT_PATTERN`` for characters below ``TAME``, whose classes are spelled out; and line feeds, which part words."""
    kinds: dict[str, str] = {"L": "", "N": "", "space": "\t\n\x0b\x0c\r \x85\xa0"}
    for c in map(chr, range(ord(TAME))):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind] += c
    letters, numbers, spaces = (re.escape(x) for x in kinds.values())
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+|\n")


def _for_units(tokenizer, n_steps: int):
    """The tokenizer for units joined by blanks, which are normalized and cut already: its model behind the steps after the first."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps = tokenizer.pre_tokenizer
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *(steps[i] for i in range(1, n_steps))])
    return bare


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ``flat`` end to end, and where each ends."""
    size = size[at]
    end = np.cumsum(size)
    return flat[np.repeat(first[at] - (end - size), size) + np.arange(end[-1] if len(end) else 0)], end


class Units:
    """Ids of texts from those of their units: words, digits and runs of symbols, which such a tokenizer encodes apart.

    Arrow cuts a piece of texts at white space, which no unit crosses, and each distinct stretch is cut into units once.
    A worker meets few distinct units: each is numbered by a dictionary, new ones are encoded together, and the
    ids of a piece of texts are gathered by array operations. Every unit ends in one id that ends a word, which tells
    the units of one answer apart. Characters from ``TAME`` on and special tokens send a text to the library whole.
    """

    def __init__(self, tokenizer, room: int = UNIT_ROOM):
        self.tokenizer, self.room = tokenizer, room
        made = json.loads(tokenizer.to_str())
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        splits = [p for p in steps if p["type"] == "Split"]
        self.fits = (made["model"].get("end_of_word_suffix") == "</w>" and (made["normalizer"] or {}).get("normalizers") == UNIT_NORMALIZERS
                     and [p["pattern"] for p in splits] == [{"Regex": UNIT_PATTERN}])
        self.parted = _for_units(tokenizer, len(steps)) if self.fits and steps[0] in splits else tokenizer
        self.units, self.wild = _unit_pattern(), re.compile(f"[{TAME}-\U0010ffff]")
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.numbers: dict[str, int] = {}  # from 1; 0 is what parts the stretches
        self.flat, self.first, self.size = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in order, and how many each has."""
        groups = [units[i : i + UNITS_TOGETHER] for i in range(0, len(units), UNITS_TOGETHER)]
        flat = [np.array(ids, np.uint32) for ids in encode_ids(self.parted, [" ".join(g) for g in groups])]
        for i, group in enumerate(groups):
            if self.ends[flat[i]].sum() != len(group):
                raise ValueError("a unit is not encoded apart")
        ids = np.concatenate(flat)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _learn(self, units: list[str]) -> None:
        ids, size = self._encoded(units)
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
        self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, ids))

    def _of(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches end to end, and how many each has."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(stretches)], stretches), "\n")[0].as_py()
        found = self.units.findall(joined)
        numbers, distinct = self.numbers, set(found) - {"\n"}
        fresh = [u for u in distinct if u not in numbers]
        if fresh:
            if len(numbers) + len(fresh) > self.room:  # those of this piece stay
                self._empty()
                numbers, fresh = self.numbers, list(distinct)
            numbers.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh)), strict=True))
            self._learn(fresh)
        at = np.fromiter(map(numbers.get, found, repeat(0)), np.int64, len(found))
        ids, end = _gathered(self.flat, self.first, self.size, at)
        ends = np.concatenate((end[at == 0], [len(ids)]))[: len(stretches)]
        return ids, np.diff(ends, prepend=0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        lowered = [t.lower() for t in texts]
        whole = [i for i, (t, low) in enumerate(zip(texts, lowered, strict=True))
                 if not self.fits or (not low.isascii() and self.wild.search(low)) or self.special.search(t)]
        for i in whole:
            lowered[i] = ""
        cut = pc.ascii_split_whitespace(pa.array(lowered, pa.string()))
        coded = cut.flatten().dictionary_encode()
        own, size = self._of(coded.dictionary)
        ids, end = _gathered(own, np.cumsum(size) - size, size, coded.indices.to_numpy())
        counts = cut.value_lengths().to_numpy()
        bounds = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(counts)))]
        sizes = np.diff(bounds)
        if whole:
            parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for i, own in zip(whole, encode_ids(self.tokenizer, [texts[i] for i in whole]), strict=True):
                parts[i] = np.array(own, np.uint32)
                sizes[i] = len(own)
            ids = np.concatenate(parts)
        return ids, sizes


@lru_cache(maxsize=2)
def load_units(path: str) -> Units:
    """The units that a worker keeps for a tokenizer's file."""
    return Units(load_json(path))
