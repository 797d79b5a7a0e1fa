"""Packing token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows. The rests, longest first, each go to
the open window with the least room that still holds them; a segment tree over remaining capacities
finds it in a few steps. Rests are dealt at random to groups of about ``GROUP_PIECES``; a group is
packed by one task and wastes at most part of its last windows, so padding stays small at every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import id_and_text, texts_in
from tidyshelf.llm.tokens import load_units
from tidyshelf.storage import Workspace

WINDOW = 4096
END_ID = 2
#: Rests that one task packs.
GROUP_PIECES = 20_000


class Windows:
    """Open windows by remaining room, under a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, window_id: int) -> None:
        self.open[room].append(window_id)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with at least that much room; None if there is none."""
        node = self.leaves + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; the lengths must come longest first."""
    tree, numbers, offsets, made = Windows(window), [], [], 0
    for n in lengths:
        found = tree.take(n)
        room, number = found or (window, made)
        made += found is None
        numbers.append(number)
        offsets.append(window - room)
        if room > n:
            tree.put(room - n, number)
    return numbers, offsets


def _cut(path: str, end_id: int, window: int, keep_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = load_units(path)
        for ids, texts in texts_in(batches, 2 << 20):
            tokens, sizes = units(texts)
            stream = np.insert(tokens.astype("<u4"), np.cumsum(sizes), end_id)
            total = sizes + 1
            begin = np.cumsum(total) - total
            pieces = -(-total // window)
            owner = np.repeat(np.arange(len(texts)), pieces)
            start = (np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]) * window
            length = np.minimum(window, total[owner] - start)
            low = begin[owner] + start
            parts = [stream[a:b] for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
            columns = [ids.take(pa.array(owner)), *map(pa.array, (start, length)), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(total[owner])]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return task


def _pack(window: int):
    def group(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        numbers, offsets = best_fit(frame["length"].tolist(), window)
        number = (int(key[0]) << 32) + np.array(numbers, np.int64)
        return pd.DataFrame({"row": frame["row"], "sequence_id": 2 * number + 1, "offset": np.array(offsets, np.int64)})

    return group


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   end_id: int = END_ID, keep_ids: bool = False, workspace: Workspace | None = None) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with ``keep_ids``).

    A null or empty text is the end id alone. Repeated rows and null ids are packed like any other; an
    empty table gives no piece; other columns are not read. Sequence ids are unique, not dense: even
    ones are full windows, odd ones packed rests.
    """
    spark = df.sparkSession
    store = workspace or Workspace(spark)
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    cut = source.mapInArrow(_cut(path, end_id, window, keep_ids), schema)
    pieces = store.freeze(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rests = pieces.filter(F.col("length") < window)
    groups = max(1, -(-rests.count() // GROUP_PIECES))
    placed = (
        rests.select("row", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"))
        .groupBy("g").applyInPandas(_pack(window), "row long, sequence_id long, offset long")
    )
    full = pieces.filter(F.col("length") >= window)
    joined = pieces.filter(F.col("length") < window).join(placed, "row").select(*pieces.columns, "sequence_id", "offset")
    alone = full.select(*pieces.columns, (2 * F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return joined.unionByName(alone).drop("row").withColumnRenamed("id", id_col)
