import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm.common import table
from tidyshelf.llm.periodic_runs import find_runs, periodic_runs


def plain_runs(words):
    """(start, length, period) of all runs, by comparing the words at every distance."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            own = words[i : i + length]
            if length >= max(6, 4 * q) and not any(q % d == 0 and own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(i, text, planted=True):
    words = (text or "").encode().split()
    if planted and i is not None and words and zlib.crc32(str(i).encode()) % 10 == 0:
        g, n = zlib.crc32(str(i).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def some_words(rng):
    """Random words with periodic pieces, some of them nested, cut short or broken by one word."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        size = rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 12, 16, 17, 31, 33])
        piece = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(size)]
        if rng.random() < 0.3:
            piece = piece * rng.randrange(2, 6) + [rng.randrange(3)]
        part = (piece * 12)[: rng.randrange(1, 7 * len(piece))]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = rng.randrange(3)
        out += part + [rng.randrange(50) for _ in range(rng.randrange(6))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_many_documents(seed):
    rng = random.Random(seed)
    docs = [some_words(rng) for _ in range(150)] + [[], [1], [0] * 700, [0, 1] * 300 + [0], list(range(500))]
    docs += [["01"[bin(i).count("1") % 2] for i in range(1024)], [i % 100 for i in range(1000)]]
    docs = [[int(w) for w in d] for d in docs]
    found = find_runs(np.array([w for d in docs for w in d]), np.array([len(d) for d in docs]))
    for i, d in enumerate(docs):
        assert [tuple(r[1:]) for r in found.tolist() if r[0] == i] == plain_runs(d)


def test_small_alphabets():
    rng = random.Random(9)
    docs = [[rng.randrange(2) for _ in range(rng.randrange(40, 120))] for _ in range(200)]
    found = find_runs(np.array([w for d in docs for w in d]), np.array([len(d) for d in docs]))
    assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, d in enumerate(docs) for r in plain_runs(d)]


def test_given_table(spark):
    docs = table(spark, SF, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = sorted(tuple(r) for r in periodic_runs(docs, planted=True).collect())
    assert got == [plain_row(*r) for r in rows]
    assert sum(r[1] for r in got) > 0


def test_odd_texts(odd, empty):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD_TEXTS)]
    for planted in (False, True):
        got = sorted((tuple(r) for r in periodic_runs(odd, planted=planted).collect()), key=str)
        assert got == sorted((plain_row(*r, planted) for r in rows), key=str)
    assert periodic_runs(empty).count() == 0
