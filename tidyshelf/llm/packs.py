"""Rows in packs: one written row holds a batch of rows, compressed, under a number of its own.

A pack is the unit in which an operator sends keys to shards and gets answers back, so that a shuffle
carries a few arrays instead of one row per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, by: str, limit: int) -> DataFrame:
    """(part, body): rows of about ``limit`` bytes of column ``by``; a longer row is a pack of its own.

    Numbers depend on how rows meet tasks, so the result must be written before it is used twice.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, options = TaskContext.get().partitionId() << 32, pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_pylist()
            start = size = 0
            for i, n in enumerate(sizes):
                size += n
                if size >= limit or i + 1 == len(sizes):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                        out.write_batch(batch.slice(start, i + 1 - start))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "body"])
                    part, start, size = part + 1, i + 1, 0

    return df.mapInArrow(task, "part long, body binary")


def unpack(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as rows:
        return rows.read_next_batch()


def answers_by_part(answers: DataFrame) -> DataFrame:
    """(part, answers): the shards' answers (part, shard, answer) of each pack in order of shards."""
    return answers.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("shard", "answer"))).alias("answers")).select(
        "part", F.col("answers.answer").alias("answers"))
