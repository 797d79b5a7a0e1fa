"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, clause end, other). Small weighted
transducers, one per kind of pattern, read the symbols: a clause scores where an insult or threat is
matched, more with a target in the clause, less below a negation or inside reported speech. The
transducers are composed once into one table of states; a text is a walk through that table.

Insults are learned: words and word beginnings that are far more frequent in toxic labelled texts. The
grammar's sums then go through a logistic curve fitted on the same labelled rows. Fitting uses a bounded
sample, ``MAX_LABELLED`` rows of each label, chosen by hash, and the curve weights its rows back to the
labels' true shares; scoring reads every text whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import crc_of, give_back, id_and_text, text_of, texts_in, unused

#: Rows of each label that the fit may read.
MAX_LABELLED = 6_000
#: A term is learned if its smoothed log odds and its toxic texts reach these.
MIN_LOG_ODDS, MIN_TEXTS = 3.0, 3
#: And its share of toxic texts must be this unlikely by chance (nats), as very many terms are tried.
MIN_GAIN = 14.0
#: Lengths of word beginnings that may stand for a family of words.
STEMS = (4, 5, 6, 7, 8)
MAX_TERMS = 20_000

#: Fixed seed words, lower case.
INSULTS = ("idiot", "moron", "loser", "scum", "stupid", "pathetic", "worthless", "disgusting", "trash", "clown", "imbecile", "vermin", "filth")
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "murder", "die", "hang")
TARGETS = ("you", "your", "you're", "u", "he", "she", "they", "them", "him", "her", "his", "their", "these", "those", "people")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "wasn't", "don't", "doesn't", "didn't", "nobody", "cannot", "can't", "without")
REPORTS = ("said", "says", "wrote", "claimed", "called", "quoted", "reported", "according", "told", "alleged")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: How many words a negation reaches forward.
REACH = 3

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """States 0..n-1, a start state, and per (state, symbol) the next state; missing ones stay."""

    states: int
    moves: dict[tuple[int, int], int]
    start: int = 0

    def step(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), self.moves.get((state, -1), state))


def negation_reach(reach: int = REACH) -> Transducer:
    """Counts down from a negation; -1 marks a move on any other symbol."""
    moves = {(s, -1): max(0, s - 1) for s in range(reach + 1)} | {(s, NEGATION): reach for s in range(reach + 1)}
    return Transducer(reach + 1, moves | {(s, END): 0 for s in range(reach + 1)})


def switch(symbol: int) -> Transducer:
    """On from a symbol to the clause's end."""
    return Transducer(2, {(0, symbol): 1, (0, END): 0, (1, END): 0})


@dataclass
class Grammar:
    """The composed transducer: a table of moves and, per state and symbol, the kind of match it emits."""

    parts: tuple[Transducer, ...] = (negation_reach(), switch(REPORT), switch(TARGET))
    table: list[list[tuple[int, int]]] = field(init=False)

    #: kinds of match: plain, with target, negated, reported; threats follow insults
    KINDS = 8

    def __post_init__(self):
        sizes = [p.states for p in self.parts]
        total = math.prod(sizes)

        def split(s: int) -> list[int]:
            out = []
            for n in sizes:
                out.append(s % n)
                s //= n
            return out

        def join(xs: list[int]) -> int:
            s = 0
            for x, n in zip(reversed(xs), reversed(sizes), strict=True):
                s = s * n + x
            return s

        self.table = []
        for s in range(total):
            negated, reported, targeted = split(s)
            kind = 2 if negated else 3 if reported else 1 if targeted else 0
            self.table.append([
                (join([p.step(x, c) for p, x in zip(self.parts, split(s), strict=True)]), kind + 4 * (c == THREAT) if c in (INSULT, THREAT) else -1)
                for c in range(7)
            ])

    def read(self, symbols: list[int], weights: list[float]) -> list[float]:
        """Weight matched per kind."""
        state, sums, table = 0, [0.0] * self.KINDS, self.table
        for c, w in zip(symbols, weights, strict=True):
            state, kind = table[state][c]
            if kind >= 0:
                sums[kind] += w
        return sums


class Lexicon:
    """Symbols and weights of words; learned terms are words and beginnings of words."""

    FIXED = dict.fromkeys(THREATS, THREAT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)
    ROOM = 400_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = dict.fromkeys(INSULTS, 1.0) | words, stems
        self.known: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        if word in self.words:
            return INSULT
        if word in self.FIXED:
            return self.FIXED[word]
        return INSULT if any(word[:n] in self.stems for n in STEMS if n < len(word)) else OTHER

    def weight(self, word: str) -> float:
        own = self.words.get(word, 0.0)
        return max([own, *(self.stems.get(word[:n], 0.0) for n in STEMS if n < len(word))])

    def symbols(self, tokens: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, tokens))
        if None in out:
            if len(known) > self.ROOM:
                known.clear()
            for i, v in enumerate(out):
                if v is None:
                    t = tokens[i]
                    out[i] = known[t] = END if len(t) == 1 and t in ".!?;:\n" else self.symbol(t)
        return out


def features(text: str, lexicon: Lexicon, grammar: Grammar) -> list[float]:
    """Log-scaled sums per kind of match, then the number of matches."""
    tokens = _TOKEN.findall(text.lower())
    symbols = lexicon.symbols(tokens)
    n = symbols.count(INSULT) + symbols.count(THREAT)
    if not n:
        return [0.0] * (Grammar.KINDS + 1)
    weights = [lexicon.weight(t) if c == INSULT else 1.0 if c == THREAT else 0.0 for t, c in zip(tokens, symbols, strict=True)]
    return [math.log1p(x) for x in grammar.read(symbols, weights)] + [math.log1p(symbols.count(INSULT))]


def _terms(text: str) -> set[str]:
    """The text's distinct words, and with a trailing star the beginnings of longer words."""
    words = {t for t in _TOKEN.findall(text.lower()) if t[0].isalpha()}
    return words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[toxic].update(_terms(text))
    terms = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(terms), 100_000):
        block = terms[at : at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.string()), *(pa.array([c[t] for t in block], pa.int64()) for c in counts)], ["term", "n0", "n1"])


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    curve: list[float]


def _sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int, held_mod: int) -> tuple[DataFrame, DataFrame]:
    """Labelled training rows, at most ``limit`` ids of each label by hash of the id, and how many rows each label has without a limit."""
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    rows = df.filter(F.col(f"`{id_col}`").isNotNull() & (F.pmod(crc_of(id_col), F.lit(held_mod)) != 0)).select(
        F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    # ids first: the sample is chosen from the labels alone, then a small table meets the texts
    picked = None
    for label in (0, 1):
        part = marked.filter((F.col("toxic") == label) & (F.pmod(crc_of("id"), F.lit(held_mod)) != 0)).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(limit)
        picked = part if picked is None else picked.unionByName(part)
    times = rows.groupBy("id").agg(F.count("*").alias("n"))
    totals = times.join(marked.distinct(), "id").groupBy("toxic").agg(F.sum("n").alias("n"))
    return rows.join(F.broadcast(picked), "id").select("toxic", "text"), totals


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        limit: int = MAX_LABELLED, held_mod: int = 5) -> Model:
    """Learn insult terms and the curve from labelled rows with crc32(id) mod ``held_mod`` not 0."""
    sample, totals = _sample(df, labels, id_col, text_col, label_col, limit, held_mod)
    sample = sample.persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        # the odds compare rates within labels and the gain tests chance within the sample, so both count sampled rows;
        # weighted counts would claim more evidence than was read
        weights_of = {r["toxic"]: r["n"] / sizes[r["toxic"]] for r in totals.collect() if sizes.get(r["toxic"])}
        counted = sample.mapInArrow(_count_terms, "term string, n0 long, n1 long").groupBy("term").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
        share, seen = n1 / max(1, n0 + n1), F.col("n0") + F.col("n1")
        gain = F.col("n1") * F.log(F.col("n1") / seen / max(share, 1e-9)) + F.when(
            F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / seen / max(1 - share, 1e-9))).otherwise(0.0)
        top = counted.filter((F.col("n1") >= MIN_TEXTS) & (odds >= MIN_LOG_ODDS) & (gain >= MIN_GAIN)).select("term", odds.alias("w"), "n1").orderBy(
            F.desc("n1"), "term").limit(MAX_TERMS).collect()
        weights = {r["term"]: float(r["w"]) for r in top}
        words = {t: w for t, w in weights.items() if not t.endswith("*")}
        stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        lexicon, grammar = Lexicon(words, stems), Grammar()

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                toxic, texts = (c.to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic, pa.int32()), pa.array([features(t, lexicon, grammar) for t in texts], pa.list_(pa.float64()))], ["y", "x"])

        seen = sample.mapInArrow(measure, "y int, x array<double>").groupBy("x", "y").count().collect()  # at most 2 * limit rows
    finally:
        sample.unpersist()
    return Model(words, stems, _logistic(seen, weights_of))


def _logistic(rows, weights_of: dict[int, float]) -> list[float]:
    """Ridge logistic regression by Newton steps, each row weighted by its label; intercept first. No rows: a curve on insults alone."""
    width = Grammar.KINDS + 1
    if len({r["y"] for r in rows}) < 2:
        return [-3.0, *([2.0] * 2 + [0.5] * 2) * 2, 1.0][: width + 1]
    x = np.array([[1.0, *r["x"]] for r in rows])
    y = np.array([r["y"] for r in rows], float)
    n = np.array([r["count"] * weights_of[r["y"]] for r in rows], float)
    b, ridge = np.zeros(width + 1), np.diag([1e-6] + [0.1] * width)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge @ b
        hessian = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def _scorer(model: Model):
    """A function from texts to their scores, with one cache of words for all calls."""
    lexicon, grammar, curve = Lexicon(model.words, model.stems), Grammar(), model.curve

    def score(text: str) -> float:
        z = curve[0] + sum(b * x for b, x in zip(curve[1:], features(text, lexicon, grammar), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   limit: int = MAX_LABELLED, held_mod: int = 5, model: Model | None = None) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted.

    Null and empty texts match nothing and get the curve's lowest score; a null id is never held out;
    repeated rows come back as they are; empty tables give empty results, and without labels a fixed
    curve over the seed words is used. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, labels, id_col, text_col, label_col, limit, held_mod))
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for ids, texts in texts_in(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(score, texts), pa.float64())], ["id", "score"])

    scored = source.mapInArrow(task, f"id {kind}, score double")
    held = F.coalesce(F.pmod(crc_of("id"), F.lit(held_mod)) == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns, whatever their names.

    Null and empty texts match nothing and stay; repeated rows and ids share their text's verdict; an empty table
    gives an empty one.
    """
    model = options.pop("model", None) or fit(df, labels, id_col, text_col, **options)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    [text] = unused(df, "text_to_score")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for batch in batches:
            at = batch.num_columns - 1
            clean = [score(t) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_())).select(list(range(at)))
        give_back()

    return df.withColumn(text, text_of(text_col)).mapInArrow(task, kinds)
