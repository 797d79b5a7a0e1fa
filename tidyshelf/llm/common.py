"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.storage import BATCH_BYTES, BATCH_KEY, Workspace

#: One uint64 multiplier and the two of a 64-bit finalizer; any odd constants do.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def ship_package(spark: SparkSession) -> None:
    """Let workers import this package by name, once per application, also where it is not installed.

    Batches between Spark and its workers are bounded in bytes, unless the application says how: texts differ in
    length by far more than a bound on rows could bear.
    """
    context = spark.sparkContext
    if not context.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    if not getattr(context, "_tidyshelf_shipped", False):
        folder = Path(tempfile.mkdtemp(prefix="tidyshelf-ship-"))  # read by the driver alone, which serves the file
        root = Path(__file__).resolve().parent.parent
        with zipfile.ZipFile(folder / "tidyshelf.zip", "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent).as_posix())
        context.addPyFile(str(folder / "tidyshelf.zip"))
        context._tidyshelf_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that others cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))


def crc_of(column: str) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary"))


def freeze(workspace: Workspace, df: DataFrame, tag: str) -> DataFrame:
    """Write once below the shared folder, and read that table from then on."""
    return workspace.freeze(df, tag)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts_in(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        ids, texts, start, size = batch.column(0), batch.column(1), 0, 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            size += n
            if size >= limit:
                yield ids.slice(start, i + 1 - start), texts.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0
        if start < len(texts):
            yield ids.slice(start), texts.slice(start).to_pylist()
    give_back()


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that hands free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Hand memory that a task no longer uses back to the system: the worker lives on for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number for a tuple of them, element by element; order matters."""
    out = mix(parts[0] + _STEP)
    for p in parts[1:]:
        out = mix((out * _STEP) ^ p)
    return out


class Hashes(dict):
    """64-bit numbers of byte strings, kept for words seen before, up to ``room`` of them."""

    def __init__(self, room: int = 200_000):
        import xxhash

        super().__init__()
        self.room, self.of = room, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        value = self[word] = self.of(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
