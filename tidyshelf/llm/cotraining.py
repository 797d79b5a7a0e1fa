"""Quality classifier by co-training of two views.

One classifier sees a document's text (shares of characters, repetition, hashed words, no length), the other its
metadata (stated length, language, source). Both start from the labelled rows. In each round each scores all
unlabelled rows, and those of which it is confident join the other's training set under that label; together
they weigh as much as the labelled rows at most. Confidence is taken from log odds calibrated on labelled rows kept apart from
the fit, so a view that knows little teaches little. The calibrated log odds are added to score all documents.

Both views of every row are written once. A Newton step is one aggregation over that table: tasks add up gradients
and Hessians of both classifiers, Spark adds those by entry, and the driver gets one number per entry, however many
rows there are. No row is sampled and none reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import Hashes, chain, crc_of, give_back, text_of, texts_in
from tidyshelf.storage import Workspace

ROUNDS = 3
#: Newton steps for the first fit, after each round's pseudo-labels, and for the calibration.
FIRST_STEPS, ROUND_STEPS, CALIBRATION_STEPS = 6, 2, 5
CONFIDENT = 0.97
#: One labelled row in so many is kept for the calibration.
APART = 5
RIDGE = 0.01
#: The largest change of a weight in one step; a full Newton step may overshoot where all odds are clear.
LONGEST_STEP = 5.0
_TERMS, _BUCKETS, _LENGTHS = 64, 8, 20
#: Roles of a row: nothing to learn from, unlabelled, labelled for the fit, labelled for the calibration.
NONE, POOL, FIT, CALIBRATE = range(4)


def text_view(raw: bytes, hashes: Hashes) -> np.ndarray:
    """Shares in a text's bytes, words and lines, then the share of words in each of some hashed buckets."""
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda symbols: float(count[list(symbols)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    h = hashes.array(words)
    thirds = chain(h[:-2], h[1:-1], h[2:]) if len(h) > 2 else h[:0]
    surface = [
        (size - of(b" \t\n\x0b\x0c\r")) / n / 10, min(1.0, of(b"#*$%&<>") / n), min(1.0, of(b"|") / n), count[65:91].sum() / size, count[48:58].sum() / size,
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(np.unique(thirds)) / max(1, len(thirds)), min(1.0, (raw.count(b"!!") + raw.count(b"??")) / n),
        of(b".,;:") / size, len(np.unique(h)) / n,
    ]
    return np.concatenate((surface, np.bincount((h % np.uint64(_TERMS)).astype(np.int64), minlength=_TERMS) / n))


def metadata_view(n_chars: int | None, lang: str | None, source: str | None) -> np.ndarray:
    """The octave of the stated length, and hashed language and source."""
    out = np.zeros(_LENGTHS + 2 * _BUCKETS)
    out[min(_LENGTHS - 1, int(max(0, n_chars or 0)).bit_length())] = 1.0
    for at, value in enumerate((lang, source)):
        out[_LENGTHS + at * _BUCKETS + zlib.crc32((value or "").encode()) % _BUCKETS] = 1.0
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes(200_000)
    for batch in batches:
        at = 0
        for ids, texts in texts_in(iter([batch])):
            rows = batch.slice(at, len(ids))
            at += len(ids)
            n, lang, source = (rows.column(c).to_pylist() for c in ("n_chars", "lang", "source"))
            a = [text_view(t.encode(), hashes).astype(np.float32).tobytes() for t in texts]
            b = [metadata_view(*m).astype(np.float32).tobytes() for m in zip(n, lang, source, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["id", "a", "b"])
    give_back()


def _matrix(column) -> np.ndarray:
    """Views as rows, led by a constant."""
    n = len(column)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(n, -1 if n else 1)
    return np.hstack([np.ones((n, 1)), flat])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sums_of(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows, gradient and Hessian of the logistic likelihood at b, in one array."""
    p = sigmoid(x @ b)
    return np.concatenate(([len(x)], x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()))


def stepped(b: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """A Newton step, no longer than ``LONGEST_STEP``, from the sums of training sets.

    A set beyond the first weighs as much as the first at most: its rows count less the more there are.
    """
    total = parts[0][1:] + sum(p[1:] * min(1.0, parts[0][0] / p[0]) for p in parts[1:] if p[0])
    gradient, hessian = total[: len(b)], total[len(b) :].reshape(len(b), len(b))
    step = np.linalg.solve(hessian + RIDGE * np.eye(len(b)), gradient - RIDGE * b)
    return b + step * min(1.0, LONGEST_STEP / max(np.abs(step).max(), 1e-9))


def _added(views: DataFrame, task, sizes: list[int]) -> list[np.ndarray]:
    """Add up the arrays that a task makes of each batch: one number per entry and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        for batch in batches:
            if batch.num_rows:
                total += np.concatenate(task(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "value"])

    out = np.zeros(sum(sizes))
    for at, value in views.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value")).collect():  # one row per entry
        out[at] = value
    return np.split(out, np.cumsum(sizes)[:-1])


def calibrated_odds(x: np.ndarray, weights: np.ndarray, line: np.ndarray) -> np.ndarray:
    return line[0] + line[1] * np.clip(x @ weights, -30, 30)


def _steps(views: DataFrame, start: list[np.ndarray], teachers: tuple[list, list] | None, steps: int) -> list[np.ndarray]:
    """Newton steps of both views; ``teachers`` (weights and calibrations) label unlabelled rows for each other's view."""
    now = start
    for _ in range(steps):
        fixed = now

        def task(batch: pa.RecordBatch) -> list[np.ndarray]:
            role, y = batch.column("role").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False)
            x, out = [_matrix(batch.column(c)) for c in ("a", "b")], []
            for i in (0, 1):
                fit = role == FIT
                out.append(sums_of(x[i][fit], y[fit], fixed[i]))  # noqa: B023
                sure, told = np.zeros(len(role), bool), y
                if teachers is not None:
                    p = sigmoid(calibrated_odds(x[1 - i], *(t[1 - i] for t in teachers)))
                    sure, told = (role == POOL) & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT)), (p >= 0.5).astype(float)
                out.append(sums_of(x[i][sure], told[sure], fixed[i]))  # noqa: B023
            return out

        sizes = [1 + len(b) + len(b) ** 2 for b in now for _ in range(2)]
        sums = _added(views, task, sizes)
        now = [stepped(b, sums[2 * i], sums[2 * i + 1]) for i, b in enumerate(now)]
    return now


def _calibrated(views: DataFrame, weights: list[np.ndarray], steps: int) -> list[np.ndarray]:
    """Intercept and slope over each view's log odds, from the rows kept apart. Steps lead up from a flat line: down from a steep one they may diverge."""
    now = [np.zeros(2)] * 2
    for _ in range(steps):
        fixed = now

        def task(batch: pa.RecordBatch) -> list[np.ndarray]:
            own = batch.column("role").to_numpy() == CALIBRATE
            y = batch.column("y").to_numpy(zero_copy_only=False)[own]
            odds = [np.clip(_matrix(batch.column(c))[own] @ w, -30, 30) for c, w in zip(("a", "b"), weights, strict=True)]
            return [sums_of(np.column_stack((np.ones(len(z)), z)), y, b) for z, b in zip(odds, fixed, strict=True)]  # noqa: B023

        sums = _added(views, task, [7, 7])
        if not sums[0][0]:
            return [np.array([0.0, 1.0])] * 2  # no such rows: the odds as they are
        now = [stepped(b, s) for b, s in zip(now, sums, strict=True)]
    return now


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  held_mod: int = 5, rounds: int = ROUNDS, workspace: Workspace | None = None) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted.

    Labels of rows with crc32(id) mod ``held_mod`` of 0 are not read. An id that has several labels has the
    smallest; a labelled id on several rows counts each time. Null and empty texts have empty views; null ids are never held out
    and never labelled; repeated rows come back as they are; empty tables give empty results, and without labels of both
    kinds every score is 0.5.
    """
    store = workspace or Workspace(df.sparkSession)
    held = F.coalesce(F.pmod(crc_of("id"), F.lit(held_mod)) == 0, F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"), F.col("n_chars").cast("long").alias("n_chars"), "lang", "source")
    known = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.min(F.when(F.col(f"`{label_col}`").isin(0, 1), F.col(f"`{label_col}`"))).cast("double").alias("y"), F.lit(True).alias("listed"))
    apart = F.pmod(F.xxhash64("id"), F.lit(APART)) == 0
    role = F.when(F.col("listed").isNull(), POOL).when(held | F.col("y").isNull(), NONE).when(apart, CALIBRATE).otherwise(FIT)
    kind = rows.schema["id"].dataType.simpleString()
    # only the views meet the labels: the texts are not shuffled
    measured = rows.mapInArrow(_measure, f"id {kind}, a binary, b binary")
    views = store.freeze(measured.join(known, "id", "left").select(
        "id", role.cast("int").alias("role"), F.coalesce("y", F.lit(0.0)).alias("y"), "a", "b"), "views")

    kinds = {r["y"] for r in views.filter(F.col("role") == FIT).select("y").distinct().collect()}
    model = None
    if kinds == {0.0, 1.0}:
        now = [np.zeros(1 + 10 + _TERMS), np.zeros(1 + _LENGTHS + 2 * _BUCKETS)]
        now = _steps(views, now, None, FIRST_STEPS)
        for _ in range(rounds):
            now = _steps(views, now, (now, _calibrated(views, now, CALIBRATION_STEPS)), ROUND_STEPS)
        model = now, _calibrated(views, now, CALIBRATION_STEPS)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.zeros(batch.num_rows)
            if shared.value and batch.num_rows:
                odds = sum(calibrated_odds(_matrix(batch.column(c)), *m) for c, *m in zip(("a", "b"), *shared.value, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigmoid(odds))], ["id", "score"])

    scored = views.select("id", "a", "b").mapInArrow(score, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
