import pytest

from tidyshelf.llm.common import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


#: Texts that every operator must bear: null, empty, blank, long, tied, repeated, odd.
ODD_TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "One two  three\n\nfour", "a" * 5000, "word " * 3000, "tie tie tie", "tie tie tie",
    "naïve Ünïcode ß ﬁ 漢字 مرحبا ́x", "x y\x1cz\x85w", "it's we're <|endoftext|> <|startoftext|>", "\n".join(["same line here"] * 40),
]


@pytest.fixture
def odd(spark):
    """Odd texts with null, repeated and tied ids, and columns whose names an operator might use itself."""
    rows = [(None if i == 3 else i // 2, t, "x", i) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens int")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
