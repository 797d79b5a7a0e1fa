"""Intermediate tables that must not be computed twice.

A frozen table is a Parquet folder below ``spark.checkpoint.dir``. Unlike a cache it survives the
loss of executors, and unlike an RDD checkpoint it is columnar, so later readers prune columns.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of an Arrow batch on its way to or from a worker.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def prepare_session(spark: SparkSession) -> SparkSession:
    """Session settings the library relies on: the last of two equal JSON keys wins, and batches of texts
    for Python are bounded in bytes, unless the application says how.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a local session without one gets its own."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tidyshelf-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


class Workspace:
    """Frozen tables of one job. ``close`` (or leaving the ``with`` block) drops them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/tidyshelf-{uuid.uuid4().hex}"
        self._count = 0

    def freeze(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{tag}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        fs.delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def workspace_for(df: DataFrame, workspace: Workspace | None) -> Workspace:
    return workspace or Workspace(df.sparkSession)
