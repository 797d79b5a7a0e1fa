import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm.common import table
from tidyshelf.llm.spelling import matrix_of, near_pairs, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def deletions(word):
    return {(i, word[:i] + word[i + 1 :]) for i in range(len(word))}


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(d == short for _, d in deletions(long))


def plain_variants(rows, thinned=None):
    count = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if thinned and i is not None and h % thinned == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    by = {}
    for w in n:
        for k in [(len(w), i, d) for i, d in deletions(w)] + [("whole", w)] + [("whole", d) for _, d in deletions(w)]:
            by.setdefault(k, set()).add(w)
    near = {w: set() for w in n}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if plain_near(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in spelling_variants(df, **options).collect())


def test_near_pairs_of_rests():
    rng = random.Random(3)
    for _ in range(300):
        w = rng.randrange(1, 6)
        words = sorted({"".join(rng.choice("abÿ") for _ in range(w + rng.randrange(2))) for _ in range(12)})
        a, b = [x for x in words if len(x) == w], [x for x in words if len(x) == w + 1]
        for right, wide in ((a, w), (b, w + 1)):
            if a and right:
                x, y = near_pairs(matrix_of(a, w)[1], matrix_of(right, wide)[1], False)
                assert {(a[i], right[j]) for i, j in zip(x, y, strict=True)} == {(p, q) for p in a for q in right if plain_near(p, q)}
    assert matrix_of(["漢a", ""], 2)[1].tolist() == [[28450, 0], [97, 0]] and np.uint8 == matrix_of(["ab"], 2)[1].dtype


@pytest.mark.parametrize("block", [3, 2048])
def test_dense_words(spark, block):
    """Words of two letters, where nearly all are near, with chains of forms and ties."""
    rng = random.Random(7)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(150)]
    words += ["strawberry", "strawbery", "strawberri", "Übermäßig", "übermäßig", "übermßig", "ÿ" * 7, "ÿ" * 8]
    texts = [(i, " ".join(w for w in words for _ in range(rng.choice([0, 1, 2, 25, 300]) if i % 3 else 1))) for i in range(9)]
    texts.append((9, "colourise " * 2 + "colorise " * 30 + "colorize " * 400 + "colorizes " * 5000))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(df, block=block) == plain_variants(texts)
    assert any(r[1] and r[1] != r[2] for r in plain_variants(texts))


@pytest.mark.parametrize("thinned", [None, 31])
def test_given_table(spark, thinned):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs, thinned=thinned) == plain_variants(rows, thinned)


def test_odd_texts(spark, odd, empty):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD_TEXTS)]
    assert got(odd, thinned=31) == plain_variants(rows, 31)
    assert got(empty) == []
    long = [(None, f"{'a' * 5000} {'a' * 5001} " * 2), (None, None), (1, f"{'a' * 5000} " * 40), (1, f"{'a' * 5000} " * 40)]
    assert got(spark.createDataFrame(long, "doc_id long, text string")) == plain_variants(long)
