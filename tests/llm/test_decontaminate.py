import hashlib
import random
import re

from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tidyshelf.llm.common import table
from tidyshelf.llm.decontaminate import clean_documents, find_hits, hit_columns, remove_spans, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items):
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1) if v else ():
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def measured(df, items, **options):
    rows = hit_columns(find_hits(df, items, **options)).select("id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_given_tables(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    expected = plain([(r["doc_id"], r["text"]) for r in docs.collect()], pairs)
    assert measured(docs, items) == expected and any(r[2] for r in expected)
    assert measured(docs, items, block_words=200) == expected


def test_overlaps_and_short_items(spark):
    rng = random.Random(2)
    sentence = lambda n: " ".join(f"w{rng.randrange(6)}" for _ in range(n))
    items = [(i, sentence(rng.choice([1, 3, 7, 12, 13, 14, 30]))) for i in range(12)] + [(50, "Only Here, two"), (51, None), (52, "..")]
    rows = [(i, sentence(rng.randrange(0, 200))) for i in range(40)] + [(90, "only-here TWO"), (91, items[4][1]), (92, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert measured(df, bench) == plain(rows, items)
    assert measured(df, bench, block_words=20) == plain(rows, items)


def test_repeated_items_count_once(spark):
    """A repeated row, and one id on two rows that both occur, in one block and in several."""
    first, second = " ".join(f"a{i}" for i in range(15)), " ".join(f"b{i}" for i in range(15))
    items = [("x", first), ("x", first), ("y", second), ("x", second)]
    rows = [(1, f"so {first} and {second}"), (2, first), (3, "nothing of them")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    expected = plain(rows, items)
    assert [r[3] for r in expected] == [2, 1, 0]
    assert measured(df, bench) == expected and measured(df, bench, block_words=20) == expected


def test_odd_texts(spark, odd, empty):
    bench = spark.createDataFrame([(1, "word " * 20), (None, "tie tie"), (2, None)], "item_id long, text string")
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD_TEXTS)]
    assert measured(odd, bench) == plain(rows, [(1, "word " * 20), (None, "tie tie"), (2, None)])
    assert measured(empty, bench) == [] and all(not r[2] for r in measured(odd, bench.limit(0)))
    for options in ({}, {"block_words": 5}):
        clean = clean_documents(odd, bench, **options)
        assert clean.columns == odd.columns
        texts = [r["text"] for r in clean.orderBy("n_tokens").collect()]
        assert texts[6].strip() == "" and texts[7] == "" and texts[0] is None and texts[4] == ODD_TEXTS[4]


def test_spans_are_cut_from_the_text():
    text = "Été, a B-c; d  e f."
    assert [w.decode() for w in words_of(text)] == ["Été", "a", "b", "c", "d", "e", "f"]
    assert remove_spans(text, [1, 3, 5, 6]) == "Été, -c; d   f."
