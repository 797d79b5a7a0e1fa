"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles. Each of ``PERMUTATIONS`` permutations of 32 bits is evaluated once per
shingle, and both its minimum and its maximum are kept: twice as many values from as many evaluations. Two
sets agree in each value with the probability of their Jaccard similarity; minimum and maximum of one permutation
cannot both be missed for the same shingle, so their sum varies less than that of two minima. Values of one kind form
bands of ``BAND_ROWS``, once side by side and once strided, so that two bands have one value in common at most; sets
with an equal band share a bucket. At a similarity of 0.8 two sets share none of the ``4 * PERMUTATIONS / BAND_ROWS``
buckets twice in a million times; above, much more rarely. At 0.3 they share one in 200 times.

Links are confirmed on the full sets. Not all pairs of a bucket are tried: the node that shares most buckets leads,
others are compared with it, links merge into components. Where a bucket still has several, a link between two of its sets
shows in their differences from the leader, see ``ngram_join.least_shared``; only sets that meet under one of their
rarest differences are compared. So a group of n copies costs about n comparisons, and no pair of a bucket is left out.

A node is a distinct set, named by the smallest row number that has it; sets are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyshelf.llm.common import Hashes, chain, id_and_text, mix, texts_in
from tidyshelf.llm.components import connected
from tidyshelf.llm.ngram_join import DIFFERENCES, differences, linked_pairs, may_link, shingles
from tidyshelf.storage import Workspace

SHINGLE = 4
#: Two sets link if PERCENT of their union is shared.
PERCENT = 80
PERMUTATIONS, BAND_ROWS = 144, 8
#: Bytes of texts whose sets are hashed together.
PIECE_BYTES = 2 << 20


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).astype(np.uint32)
    return drawn[:n] | np.uint32(1), drawn[n:]


def min_max(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima, one row per (filled) set and one column per permutation x * a + b modulo 2**32."""
    flat = np.concatenate(sets).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    low, high = (np.empty((permutations, len(sets)), np.uint32) for _ in range(2))
    for p, (a, b) in enumerate(zip(*_coefficients(permutations), strict=True)):
        value = flat * a + b
        np.minimum.reduceat(value, starts, out=low[p])
        np.maximum.reduceat(value, starts, out=high[p])
    return low.T, high.T


def bands(sets: list[np.ndarray], permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per set and band; bands hold minima or maxima of ``rows`` permutations (a divisor)."""
    keys, count = [], permutations // rows
    for kind, values in enumerate(min_max(sets, permutations)):
        columns = [np.ascontiguousarray(values[:, i]).astype(np.uint64) for i in range(permutations)]
        for at in range(count):
            for way, own in enumerate((columns[at * rows : (at + 1) * rows], columns[at::count])):
                keys.append(chain(np.full(len(sets), 4 * at + 2 * kind + way, np.uint64), *own))
    return np.stack(keys, 1)


def _members(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, squeeze = Hashes(), zstandard.ZstdCompressor(level=1)
        for ids, texts in texts_in(batches, PIECE_BYTES):
            n, digest, body, place, sets = [], [], [], {}, []
            for text in texts:
                own = shingles(text, hashes, size)
                n.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                body.append(squeeze.compress(text.encode()))
                if len(own) and digest[-1] not in place:  # equal sets of a piece are hashed once
                    place[digest[-1]] = len(sets)
                    sets.append(own)
            keys = bands(sets).view(np.int64).tolist() if sets else []
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(body, pa.binary()),
                pa.array([None if d is None else keys[place[d]] for d in digest], pa.list_(pa.int64())),
            ], ["id", "n", "digest", "body", "bands"])

    return task


def _links(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = bodies.select(F.col("node").alias("a"), F.col("body").alias("p"))
    right = bodies.select(F.col("node").alias("b"), F.col("body").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(linked_pairs(size, percent), "a long, b long")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _placed(rows: DataFrame, groups: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    found = groups.select(F.col("node").alias(node), F.col("component").alias(component))
    return rows.join(found, node, "left").withColumn(component, F.coalesce(component, node))


def _untried(buckets: DataFrame, groups: DataFrame, bodies: DataFrame, size: int, percent: int, store: Workspace) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and enough differences from its leader."""
    spread = _placed(buckets, groups).groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    parted = buckets.join(spread.select("band"), "band", "left_semi").filter("node <> leader").select("leader", "node").distinct()
    both = parted.join(bodies.select(F.col("node").alias("leader"), F.col("body").alias("p")), "leader").join(
        bodies.select("node", F.col("body").alias("q")), "node").select("leader", "node", "p", "q")
    apart = store.freeze(both.mapInArrow(differences(size, percent), DIFFERENCES), "apart")
    rarity = apart.groupBy("leader", "element").agg(F.count("*").alias("times")).filter("times > 1")
    rank = F.row_number().over(Window.partitionBy("leader", "node").orderBy("times", "element"))
    sought = apart.join(rarity, ["leader", "element"], "left").withColumn("times", F.coalesce("times", F.lit(1))).withColumn(
        "rank", rank).filter("rank <= needed AND times > 1").select("leader", "element", "node", "size", "apart")
    offered = apart.filter("NOT linked").select(
        "leader", "element", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("apart").alias("other_apart"))
    meeting = _placed(sought, groups).join(_placed(offered, groups, "other", "other_component"), ["leader", "element"])
    return meeting.filter("component <> other_component").filter(may_link(percent)).select(*_ordered("node", "other")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
                    workspace: Workspace | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links), kept (whether the id is that).

    Null, empty and blank texts have no shingles and link with nothing. Equal sets always link. Repeated rows
    and ids are kept; a null id never names a component that has another id, and is kept only where there is
    none. An empty table gives an empty one; other columns are not read.
    """
    store = workspace or Workspace(df.sparkSession)
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    members = store.freeze(source.mapInArrow(_members(size), f"id {kind}, n long, digest binary, body binary, bands array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "members")
    nodes = store.freeze(members.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("least")), "nodes")
    chosen = nodes.select(F.col("node").alias("row"))
    keys = members.select("row", "bands").join(chosen, "row", "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    keys = store.freeze(keys, "keys")
    shared = keys.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    sized = store.freeze(keys.join(shared, "band"), "sized")
    weights = sized.groupBy("node").agg(F.sum("size").alias("weight"))
    central = F.min(F.struct((-F.col("weight")).alias("less"), "node"))["node"]
    led = sized.join(weights, "node").groupBy("band").agg(central.alias("leader"))
    buckets = store.freeze(sized.join(led, "band").select("band", "node", "leader"), "buckets")
    bodies = store.freeze(members.select(F.col("row").alias("node"), "body").join(buckets.select("node").distinct(), "node", "left_semi"), "bodies")

    pairs = buckets.filter("node <> leader").select(*_ordered("node", "leader")).distinct()
    found = store.freeze(_links(pairs, bodies, size, percent), "links")
    groups = connected(found, store)
    more = store.freeze(_links(_untried(buckets, groups, bodies, size, percent, store), bodies, size, percent), "links")
    if not more.isEmpty():
        groups = connected(found.unionByName(more), store)

    placed = _placed(nodes, groups)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    names = placed.select("digest", "component").join(named, "component").select("digest", "component_id")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return members.select("id", "n", "digest").join(names, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.equal_null("id", component).alias("kept"))
