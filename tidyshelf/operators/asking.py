"""Calls of a caller's extractor inside tasks: several in flight, at a bounded rate, recorded as they come."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = "key STRING, attempt INT, raw_output STRING"
_FILE_SCHEMA = pa.schema([("key", pa.string()), ("attempt", pa.int32()), ("raw_output", pa.string())])
#: Answers in one frame that a task hands on.
FRAME_ROWS = 1_000


class Prompt(NamedTuple):
    """What the extractor gets."""

    id: int
    raw_description: str | None
    prompt: str | None
    attempt: int


def _file_system(uri: str):
    """The Arrow file system and path of a qualified URI."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Ledger:
    """Answers on record below ``path``, a folder that all executors share: a row per prompt and attempt.

    Each task appends a small file after every ``commit_rows`` answers, under a name that readers see only when the
    file is whole. A task that is lost and starts again takes over what it had recorded, and a job that
    is started again asks only for what is not there. At most ``commit_rows`` answers per lost task are asked
    twice, none with 1. A failed call is on record too: a run does not repeat it. Prompts are told apart by their text
    (by SHA-256), so another model or setting wants another folder.
    """

    path: str
    commit_rows: int = 20

    def qualified(self, spark: SparkSession) -> str:
        """The path with its scheme; the folder exists from then on."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(path)
        return files.makeQualified(path).toString()

    def _files(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        return reader.parquet(self.qualified(spark))

    def answers(self, spark: SparkSession) -> DataFrame:
        """(key, attempt, raw_output), one row per key and attempt. An answer that was recorded twice counts once."""
        return self._files(spark).groupBy("key", "attempt").agg(F.max("raw_output").alias("raw_output"))

    def compact(self, spark: SparkSession) -> None:
        """Write the small files into one table below the folder, then drop them. Run it while no job asks.

        If it is stopped halfway, answers are there twice, which readers bear.
        """
        root = self.qualified(spark)
        files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        path = spark._jvm.org.apache.hadoop.fs.Path
        old = [entry.getPath() for entry in files.listStatus(path(root))]
        self.answers(spark).write.parquet(f"{root}/table-{uuid.uuid4().hex}")
        for entry in old:
            files.delete(path(entry.toString()), True)


class _Record:
    """The files of one task of one round."""

    def __init__(self, folder: str, commit_rows: int):
        self.files, self.folder = _file_system(folder)
        self.commit_rows, self.rows = commit_rows, []
        self.files.create_dir(self.folder, recursive=True)

    def known(self) -> dict[str, str | None]:
        """What an earlier try of this task had recorded; no more than the task's own rows."""
        from pyarrow import fs

        found: dict[str, str | None] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.folder)):
            if info.base_name.startswith("part-"):
                table = pq.read_table(info.path, filesystem=self.files)
                found.update(zip(table["key"].to_pylist(), table["raw_output"].to_pylist(), strict=True))
        return found

    def add(self, key: str, attempt: int, answer: str | None) -> None:
        self.rows.append({"key": key, "attempt": attempt, "raw_output": answer})
        if len(self.rows) >= self.commit_rows:
            self.commit()

    def commit(self) -> None:
        if self.rows:
            name = uuid.uuid4().hex
            hidden = f"{self.folder}/_{name}.parquet"
            with self.files.open_output_stream(hidden) as out:
                pq.write_table(pa.Table.from_pylist(self.rows, _FILE_SCHEMA), out)
            self.files.move(hidden, f"{self.folder}/part-{name}.parquet")
            self.rows = []


class _Pace:
    """Slots in time, ``rate`` of them a second."""

    def __init__(self, rate: float | None):
        self.step, self.next = (1 / rate if rate else 0.0), time.monotonic()

    def wait(self) -> None:
        if self.step:
            now = time.monotonic()
            if self.next > now:
                time.sleep(self.next - now)
            self.next = max(self.next, now) + self.step


def _answers(calls: Iterator[tuple[Any, Prompt]], extractor: Callable, in_flight: int, pace: _Pace) -> Iterator[tuple[Any, str | None]]:
    """The answers in the order in which they come, with the calls' tags; a call that raises is answered by None."""

    def ask(prompt: Prompt) -> Any:
        try:
            return extractor(prompt)
        except Exception:  # noqa: BLE001 - a failed call is data
            return None

    def ended(some) -> Iterator[tuple[Any, str | None]]:
        for future in some:
            answer, tag = future.result(), waiting.pop(future)
            if answer is not None and not isinstance(answer, str):
                raise TypeError(f"the extractor returned {type(answer).__name__}, not a text or None")
            yield tag, answer

    with ThreadPoolExecutor(in_flight) as pool:
        waiting: dict = {}
        for tag, prompt in calls:
            pace.wait()
            waiting[pool.submit(ask, prompt)] = tag
            if len(waiting) >= in_flight:
                yield from ended(wait(waiting, return_when=FIRST_COMPLETED).done)
        while waiting:
            yield from ended(wait(waiting, return_when=FIRST_COMPLETED).done)


def asking(extractor: Callable[[Prompt], str | None], attempt: int, pause: float, in_flight: int = 1, rate: float | None = None,
           tag: str = "id", folder: str | None = None, commit_rows: int = 1):
    """A task for ``mapInPandas`` over (``tag``, id, raw_description, prompt): frames of (tag, attempt, raw_output).

    ``in_flight`` calls run at once, ``rate`` start a second. With ``folder`` answers are recorded below it, by task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record = _Record(f"{folder}/{TaskContext.get().partitionId()}", commit_rows) if folder else None
        known = record.known() if record else {}
        out: list[tuple[Any, int, str | None]] = []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=[tag, "attempt", "raw_output"])
            out.clear()
            return made.astype({"attempt": "int32", "raw_output": "object"} | ({"id": "int64"} if tag == "id" else {}))

        def calls() -> Iterator[tuple[Any, Prompt]]:
            for i, batch in enumerate(batches):
                if pause and not i:
                    time.sleep(pause)
                for name, *fields in batch[[tag, "id", "raw_description", "prompt"]].itertuples(index=False, name=None):
                    if name in known:
                        out.append((name, attempt, known[name]))
                    else:
                        yield name, Prompt(*fields, attempt)

        try:
            for name, answer in _answers(calls(), extractor, in_flight, _Pace(rate)):
                out.append((name, attempt, answer))
                if record:
                    record.add(name, attempt, answer)
                if len(out) >= FRAME_ROWS:
                    yield frame()
        finally:
            if record:
                record.commit()
        yield frame()

    return run


def key_of(prompt: str = "prompt") -> Column:
    """The name of a prompt in the ledger."""
    return F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256)
