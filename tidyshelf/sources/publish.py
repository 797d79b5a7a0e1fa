"""Tables that readers see whole: staged writes, one step that makes them current, repeatable appends.

Nothing is replaced before all of its successor is written. ``replace_tables`` moves staged folders to fixed paths and
keeps a journal, so a job that dies between two renames is finished by the next one. ``publish_results`` moves
nothing: a manifest names the current run, and its renaming makes all tables of the run current at once, also
where renaming a folder would copy it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_current.json"


class Files:
    """The few file system calls needed, by Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        files, at = self._at(path)
        return files.exists(at)

    def delete(self, path: str) -> None:
        files, at = self._at(path)
        files.delete(at, True)

    def rename(self, source: str, target: str) -> None:
        files, at = self._at(source)
        if not files.rename(at, self.jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"could not rename {source} to {target}")

    def read(self, path: str) -> str:
        files, at = self._at(path)
        stream = files.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a small file under another name, then rename it over ``path``: readers see the old or the new one."""
        hidden = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        files, at = self._at(hidden)
        stream = files.create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        options = self.jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.OVERWRITE.getClass(), 1)
        options[0] = fs.Options.Rename.OVERWRITE
        qualified = files.makeQualified(at)
        fs.FileContext.getFileContext(qualified.toUri(), self.conf).rename(qualified, files.makeQualified(fs.Path(path)), options)


def _journal(paths: list[str]) -> str:
    name = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]
    return f"{paths[0].rpartition('/')[0] or '.'}/_publish-{name}.json"


def _swap(files: Files, moves: list[dict[str, str]]) -> None:
    """Put staged folders in place; what is done already is passed over."""
    for m in moves:
        if files.exists(m["staged"]):
            if files.exists(m["path"]):
                files.rename(m["path"], m["old"])
            files.rename(m["staged"], m["path"])
        files.delete(m["old"])


def recover(spark: SparkSession, *paths: str) -> bool:
    """Finish a replacement of these tables (given in the same order) that was cut short. Whether there was one."""
    files, journal = Files(spark), _journal([p.rstrip("/") for p in paths])
    if not files.exists(journal):
        return False
    _swap(files, json.loads(files.read(journal)))
    files.delete(journal)
    return True


def replace_tables(spark: SparkSession, writes: Mapping[str, Callable[[str], None]]) -> None:
    """Write each table (path: what writes it to a given folder) next to its path, then put all in place.

    If a write fails, no path has changed and what was staged is dropped. Once all are written, the moves
    are on record, and a job that dies among them is finished by ``recover``, which runs first.
    """
    files, run = Files(spark), uuid.uuid4().hex
    paths = [p.rstrip("/") for p in writes]
    recover(spark, *paths)
    moves = [{"path": p, "staged": f"{p}.staged-{run}", "old": f"{p}.old-{run}"} for p in paths]
    try:
        for move, write in zip(moves, writes.values(), strict=True):
            write(move["staged"])
    except BaseException:
        for move in moves:
            files.delete(move["staged"])
        raise
    files.write(_journal(paths), json.dumps(moves))
    recover(spark, *paths)


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], keep: int = 2) -> str:
    """Write tables as Parquet in a folder of their own below ``root``, then make them all current by one rename.

    The last ``keep`` runs stay for readers that began before. Returns the run's name.
    """
    files, root, run = Files(spark), root.rstrip("/"), f"run-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{root}/{run}/{name}")
    except BaseException:
        files.delete(f"{root}/{run}")
        raise
    known = json.loads(files.read(f"{root}/{MANIFEST}"))["runs"] if files.exists(f"{root}/{MANIFEST}") else []
    files.write(f"{root}/{MANIFEST}", json.dumps({"runs": [run, *known[: keep - 1]], "tables": list(tables)}))
    for old in known[keep - 1 :]:
        files.delete(f"{root}/{old}")
    return run


def read_published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current tables by name; all of one run."""
    root = root.rstrip("/")
    manifest = json.loads(Files(spark).read(f"{root}/{MANIFEST}"))
    return {name: spark.read.parquet(f"{root}/{manifest['runs'][0]}/{name}") for name in manifest["tables"]}
