import random

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm.common import mix, table
from tidyshelf.llm.minmax_dedup import bands, min_max, near_duplicates


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain_rows(rows):
    """Components by trying all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {r: min((x for x in own if x is not None), default=None) for r, own in ids.items()}
    return sorted(((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)


def sets_of(rng, n, shared, own):
    values = mix(np.array([rng.getrandbits(62) for _ in range(shared + 2 * own)], np.uint64))
    return values[: shared + own], np.concatenate((values[:shared], values[shared + own :]))


def test_values_estimate_the_similarity():
    """Minima and maxima agree as often as the sets are similar, and their sum varies less than two minima's."""
    rng = random.Random(2)
    agree = []
    for _ in range(150):
        low, high = min_max(list(sets_of(rng, 60, 40, 5)))
        agree.append([low[0] == low[1], high[0] == high[1]])
    agree = np.array(agree, float)
    assert np.abs(agree.mean((0, 2)) - 0.8).max() < 0.01
    both = agree.sum(1)
    assert both.var() < 2 * agree[:, 0].var()


def test_similar_sets_share_a_band():
    rng = random.Random(4)
    for _ in range(300):
        own = rng.choice([1, 2, 5, 30])
        keys = bands(list(sets_of(rng, 0, 8 * own, own)))
        assert (keys[0] == keys[1]).any()
    apart = [(lambda k: (k[0] == k[1]).any())(bands(list(sets_of(rng, 0, 20, 40)))) for _ in range(200)]
    assert sum(apart) < 3


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_and_chains(spark, seed):
    """Groups whose members link only through others, around a passage that unrelated documents share too."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 80, 200]))]
        if g % 2:
            base = base[:20] + passage + base[20:]
        for _ in range(25):
            copy = list(base) if rng.random() < 0.7 or not rows else list(rows[-1][1].split())
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * g + rng.randrange(1000), " ".join(copy)))
    rows += [(7000 + i, " ".join([f"y{rng.randrange(10**6)}" for _ in range(12)] + passage)) for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain_rows(rows)


def test_given_table(spark):
    docs = table(spark, SF, "documents")
    assert got(docs) == plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_texts(odd, empty):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD_TEXTS)]
    assert got(odd) == plain_rows(rows)
    assert near_duplicates(empty).count() == 0
