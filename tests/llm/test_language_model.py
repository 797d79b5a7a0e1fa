import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm import language_model
from tidyshelf.llm.common import Hashes, table
from tidyshelf.llm.language_model import _add_words, _discounts, _pack_words, score_held_out, score_texts, spread, total_mass, train
from tidyshelf.storage import Workspace


def tokens(text):
    return [*(text or "").encode().lower().split(), "</s>"]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            self.bi.update(zip(["<s>", *w], w))
        self.follows, self.context, self.kinds = Counter(b for _, b in self.bi), Counter(), {}
        for (a, _), n in self.bi.items():
            self.context[a] += n
            self.kinds.setdefault(a, [0, 0, 0])[min(n, 3) - 1] += 1
        seen = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        self.high, self.low = _discounts(seen(self.bi)), _discounts(seen(self.follows))
        self.mass = sum(self.low[min(n, 3) - 1] for n in self.follows.values())

    def probability(self, a, b):
        off = lambda n, d: 0 if not n else d[min(n, 3) - 1]
        total = max(1, len(self.bi))
        base = (self.follows[b] - off(self.follows[b], self.low)) / total + self.mass / total / (len(self.uni) + 1)
        if not self.context[a]:
            return base
        rest = sum(n * d for n, d in zip(self.kinds[a], self.high)) / self.context[a]
        return (self.bi[a, b] - off(self.bi[a, b], self.high)) / self.context[a] + rest * base

    def score(self, text):
        w = tokens(text)
        return sum(np.log10(self.probability(a, b)) for a, b in zip(["<s>", *w], w))

    def base(self, text):
        n, v = sum(self.uni.values()), len(self.uni)
        return sum(np.log10((self.uni[w] + 1) / (n + v + 1)) for w in tokens(text))


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def compare(df, rows):
    plain = Plain([t for i, t in rows if not held(i)])
    expected = sorted((str(i), held(i), len(tokens(t)), sum(plain.uni[w] > 0 for w in tokens(t)), sum(plain.uni.values()),
                       round(plain.base(t), 6), round(plain.score(t), 6)) for i, t in rows)
    got = sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in score_held_out(df).collect())
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert np.allclose([g[5:] for g in got], [e[5:] for e in expected], atol=1e-4)
    return got


def test_given_table(spark):
    docs = table(spark, SF, "documents")
    got = compare(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    out = [g for g in got if g[1]]
    assert out and sum(g[6] for g in out) > sum(g[5] for g in out)


@pytest.mark.parametrize("pieces", [200, 1 << 20])
def test_frequent_words_and_many_shards(spark, monkeypatch, pieces):
    """Counts over 255, hot contexts, and texts in several pieces."""
    monkeypatch.setattr(language_model, "PIECE_BYTES", pieces)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "the", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(0, 90)))) for i in range(80)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_odd_texts(spark, odd, empty):
    compare(odd, [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD_TEXTS)])
    assert score_held_out(empty).count() == 0


def test_mass_is_one(spark):
    texts = spark.createDataFrame([("a b a c a b b d",), ("a b c",), ("d d a",)], "text string")
    model = train(texts, Workspace(spark))
    names = Hashes().array([b"a", b"b", b"c", b"d"])
    keys = np.sort(np.append(names, np.uint64(language_model.END)))
    known = model.words_of(keys)
    for at in range(5):
        first = np.full(5, keys[at] >> np.uint64(24))
        counts = model.bigrams_of(first, keys >> np.uint64(24))
        assert abs(total_mass(model, known[at, 2:], known[:, 1], counts) - 1) < 1e-9
    assert score_texts(texts, model, "text").count() == 3


def test_counts_beyond_32_bits():
    """Packs and shards carry counts that no 32 bits hold."""
    keys, counts = np.array([3, 9, 12], np.uint64), np.array([[2**33 + 5], [1], [2**31]], np.int64)
    packed = pa.Table.from_batches([_pack_words("uni", keys, counts, 1)] * 3)
    added = _add_words(packed)
    assert added["tokens"].to_pylist() == [3 * int(counts.sum())]
    assert spread(added["values"][0].as_py(), np.uint64).tolist() == [3 * int(c) for c in counts[:, 0]]
