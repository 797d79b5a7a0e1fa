import random

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm.common import mix, table
from tidyshelf.llm.ngram_join import jaccard_components, least_shared, signatures


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_components(rows):
    """rows: (id, text). Components by trying all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = doc if least.get(r) is None else least[r] if doc is None else min(least[r], doc)
    return sorted(((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def test_similar_sets_share_a_signature():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.choice([2, 9, 10, 11, 19, 20, 38, 57, 90, 300])
        a = set(rng.sample(range(10**9), n))
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // 10))):
            if rng.random() < 0.6:
                b.discard(rng.choice(sorted(b)))
            if rng.random() < 0.6:
                b.add(rng.randrange(10**9, 2 * 10**9))
        if b and a != b and 100 * len(a & b) >= 90 * len(a | b):
            sets = [np.unique(mix(np.array(sorted(x), np.uint64))) for x in (a, b)]
            sig, owner = signatures(sets)
            assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_and_chains(spark, seed):
    """Groups whose members link only through others, in words few enough for frequent ties."""
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 80, 200]))]
        for _ in range(25):
            copy = list(base) if rng.random() < 0.7 else list(rows[-1][1].split()) if rows else list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * g + rng.randrange(1000), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows)


def test_given_table_and_odd_texts(spark, odd, empty):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str) == plain_components(rows)
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD_TEXTS)]
    assert sorted((tuple(r) for r in jaccard_components(odd).collect()), key=str) == plain_components(rows)
    assert jaccard_components(empty).count() == 0


def test_links_show_in_the_differences_from_a_leader():
    """Whoever links to y but not to the leader shares at least as many of y's differences as stated."""
    rng = random.Random(11)
    tried = 0
    for _ in range(4000):
        leader = set(range(rng.choice([20, 38, 60, 150])))
        y = set(leader)
        for _ in range(rng.randrange(0, len(leader) // 4)):
            y.discard(rng.choice(sorted(y)))
            y.add(rng.randrange(1000, 1400))
        x = set(y)
        for _ in range(rng.randrange(0, len(leader) // 10)):
            x.discard(rng.choice(sorted(x)))
            if rng.random() < 0.7:
                x.add(rng.randrange(1000, 1400))
        link = lambda a, b: 100 * len(a & b) >= 90 * len(a | b)
        if link(x, y) and not link(x, leader) and y != leader:
            tried += 1
            assert len((x ^ leader) & (y ^ leader)) >= least_shared(len(y ^ leader), len(y), len(leader))
    assert tried > 100
