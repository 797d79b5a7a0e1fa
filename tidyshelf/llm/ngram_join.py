"""N-gram Jaccard self-join with PartEnum signatures.

Sets of word shingles are put in bands of sizes that may match each other. Within a band two similar sets
differ in at most k shingles. The shingle domain is partitioned; subsets of the partitions are enumerated
so that any k differences leave one subset untouched: similar sets share its signature. Small k takes
pairs of k + 2 partitions; larger k takes single ones of more than k partitions.

Sets with one signature form a bucket. Not all its pairs are tried: the set that shares most buckets
leads, the others are compared with it exactly, and links merge into components. If a bucket still has
several components, a link between two of its sets would have to show in their differences from the
leader: of x, not linked to the leader, and y, more than half of y's differences are differences of x as
well (``least_shared``). So y is sought under its rarest differences, one more than may be missing, and x
under all of its own; only pairs that meet there are compared. No link is lost, and a group of n copies
costs about n comparisons, whether they link or not.

Equal sets are one node from the start. A node is named by 64 bits of a hash of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyshelf.llm.common import Hashes, chain, give_back, id_and_text, mix, texts_in
from tidyshelf.llm.components import connected
from tidyshelf.storage import Workspace

SHINGLE = 3
#: Two sets link if PERCENT of their union is shared.
PERCENT = 90
#: Signatures that one task groups.
SHARD_ENTRIES = 3_000_000
#: Bytes of texts whose signatures are made together.
PART_BYTES = 4 << 20


def shingles(text: str, hashes: Hashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit numbers; a shorter text is one shingle, no words none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.array(words)
    if len(w) < size:
        return chain(np.full(1, len(w), np.uint64), *(w[i : i + 1] for i in range(len(w))))
    return np.unique(chain(*(w[i : len(w) - size + 1 + i] for i in range(size))))


def bands(most: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Size bands (from, to), up to ``most``, one more: sets that match lie in one band or in neighbours."""
    out, low = [], 1
    while low <= most or len(out) < 2 or out[-1][0] <= most:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


def plan(high: int, percent: int = PERCENT) -> tuple[int, int]:
    """k and the number of partitions for sets of up to ``high`` shingles."""
    k = 2 * high * (100 - percent) // (100 + percent)
    return k, (k + 2 if k <= 2 else k + 1 + max(1, k // 16))


def _sums(sets: list[np.ndarray], counts: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per set and partition: owner, place, and a hash of the partition's shingles (0: none)."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    mixed = mix(flat ^ mix(tag.astype(np.uint64) + np.uint64(77))[owner])
    place = ((mixed >> np.uint64(32)) * counts[owner].astype(np.uint64)) >> np.uint64(32)
    first = np.concatenate(([0], np.cumsum(counts)))
    cell = first[owner] + place.astype(np.int64)
    # exact sums of 26-bit pieces; a set has fewer than 2**27 shingles
    low, high = (np.bincount(cell, x.astype(np.float64), first[-1]).astype(np.uint64) for x in (
        mix(mixed) & np.uint64((1 << 26) - 1), mix(mixed) >> np.uint64(38)))
    owners = np.repeat(np.arange(len(sets)), counts)
    places = np.arange(first[-1]) - first[:-1][owners]
    filled = np.bincount(cell, minlength=first[-1]) > 0
    return owners, places, np.where(filled, chain(low, high) | np.uint64(1), np.uint64(0))


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the sets that own them."""
    if not sets:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    edges = bands(int(sizes.max()), percent)
    own = np.searchsorted([low for low, _ in edges], sizes, side="right") - 1
    plans = np.array([plan(high, percent) for _, high in edges])
    out, owners = [], []
    for tag in (own, own + 1):
        k, m = plans[tag, 0], plans[tag, 1]
        chosen = np.flatnonzero((k > 0) & (sizes > 0))  # k = 0: only equal sets match, and those are one node
        if not len(chosen):
            continue
        k, m, t = k[chosen], m[chosen], tag[chosen].astype(np.uint64)
        owner, place, value = _sums([sets[i] for i in chosen], m, t)
        pairs = k[owner] <= 2
        # subsets of two of the k + 2 partitions
        at = np.flatnonzero(pairs)
        for gap in (1, 2, 3):
            a = at[place[at] + gap < m[owner[at]]]
            out.append(chain(t[owner[a]], (place[a] * 8 + gap).astype(np.uint64), value[a], value[a + gap]))
            owners.append(chosen[owner[a]])
        # single partitions: at least m - k of them are untouched, so empty ones matter only from there on
        empty = np.bincount(owner, value == 0, len(chosen))
        a = np.flatnonzero(~pairs & ((value > 0) | (empty >= m - k)[owner]))
        out.append(chain(t[owner[a]], place[a].astype(np.uint64) + np.uint64(1 << 32), value[a]))
        owners.append(chosen[owner[a]])
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate(owners) if owners else np.empty(0, np.int64)


def _unpack(body: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(body).decode()


def _signed(sets: dict[int, np.ndarray], shards: int, percent: int, squeeze: zstandard.ZstdCompressor) -> dict[str, pa.Array]:
    """One row per shard: sorted signatures, and for each the place of its node in a list."""
    nodes = np.array(list(sets), np.int64)
    sig, owner = signatures(list(sets.values()), percent)
    shard = (sig % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((sig, shard))
    sig, owner, shard = sig[order], owner[order], shard[order]
    rows = {"shard": [], "sigs": [], "places": [], "nodes": []}
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[s], cuts[s + 1]
        held, place = np.unique(owner[a:b], return_inverse=True)
        steps = np.diff(sig[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()
        rows["shard"].append(int(s))
        rows["sigs"].append(squeeze.compress(steps.tobytes()))
        rows["places"].append(squeeze.compress(place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()))
        rows["nodes"].append(nodes[held].tobytes())
    return {c: pa.array(v, pa.int32() if c == "shard" else pa.binary()) for c, v in rows.items()}


def _members(size: int, percent: int, shards: int):
    """Rows of two kinds from one pass over the texts: members, and below a shard the signatures of a part's sets."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, squeeze = Hashes(), zstandard.ZstdCompressor(level=1)
        for ids, texts in texts_in(batches, PART_BYTES):
            n, node, body, sets = [], [], [], {}
            for text in texts:
                own = shingles(text, hashes, size)
                n.append(len(own))
                node.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None)
                body.append(squeeze.compress(text.encode()))
                if len(own):  # a part's equal sets are signed once
                    sets[node[-1]] = own
            members = {"id": ids, "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "body": pa.array(body, pa.binary())}
            signed = _signed(sets, shards, percent, squeeze)
            kinds = {c: v.type for c, v in (members | signed).items()}
            for rows in (members, signed):
                count = len(next(iter(rows.values())))
                yield pa.RecordBatch.from_arrays([rows.get(c, pa.nulls(count, k)) for c, k in kinds.items()], list(kinds))
        hashes.clear()
        give_back()

    return task


def _buckets(table: pa.Table) -> pa.Table:
    """The shard's signatures that two or more nodes have, with these nodes."""
    unpack = zstandard.ZstdDecompressor()
    sig, node = [], []
    for row in table.select(["sigs", "places", "nodes"]).to_pylist():
        steps = np.frombuffer(unpack.decompress(row["sigs"]), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
        place = np.frombuffer(unpack.decompress(row["places"]), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        sig.append(np.cumsum(steps, dtype=np.uint64))
        node.append(np.frombuffer(row["nodes"], np.int64)[place])
    sig, node = np.concatenate(sig), np.concatenate(node)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    _, inverse, count = np.unique(sig, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    return pa.table({"sig": sig[keep].view(np.int64), "node": node[keep], "size": count[inverse][keep].astype(np.int64)})


def linked_pairs(size: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = Hashes(), {}

        def set_of(node: int, body: bytes) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[node] = shingles(_unpack(body), hashes, size)
            return kept[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for x, y, p, q in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = set_of(x, p), set_of(y, q)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                out.append(100 * shared >= percent * (len(s) + len(t) - shared))
            mask = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return task


def least_shared(differences: int, size: int, leader: int, percent: int = PERCENT) -> int:
    """How many of y's differences from the leader every set must share that links to y but not to the leader.

    Sets a and b link if they differ in at most (a + b) * r shingles, r = (100 - percent) / (100 + percent).
    With d(x) > (x + leader) * r, and |x - y| = d(x) + d(y) - 2 * shared <= (x + y) * r, it follows that
    2 * shared > d(y) + (leader - y) * r.
    """
    low, high = 100 - percent, 100 + percent
    return max(1, (differences * high + (leader - size) * low) // (2 * high) + 1)


#: Columns of ``differences``.
DIFFERENCES = "leader long, node long, linked boolean, needed long, size long, apart long, element long"


def differences(size: int, percent: int):
    """Of each node and its leader: whether they link, the node's size, and every shingle that only one of them has."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = Hashes(), {}
        for batch in batches:
            rows = {c.split()[0]: [] for c in DIFFERENCES.split(", ")}
            for leader, node, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if leader not in kept:
                    if len(kept) >= 64:
                        kept.clear()
                    kept[leader] = shingles(_unpack(p), hashes, size)
                lead, own = kept[leader], shingles(_unpack(q), hashes, size)
                apart = np.setxor1d(lead, own, assume_unique=True)
                n = len(apart)
                rows["leader"].append(np.full(n, leader))
                rows["node"].append(np.full(n, node))
                rows["linked"].append(np.full(n, n * (100 + percent) <= (len(lead) + len(own)) * (100 - percent)))
                # so many of the rarest differences must hold one that is shared
                rows["needed"].append(np.full(n, n - least_shared(n, len(own), len(lead), percent) + 1))
                rows["size"].append(np.full(n, len(own)))
                rows["apart"].append(np.full(n, n))
                rows["element"].append(apart.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(v) if v else [], pa.bool_() if c == "linked" else pa.int64()) for c, v in rows.items()], list(rows))

    return task


def may_link(percent: int) -> Column:
    """What linked sets of (size, apart) and (other_size, other_apart) fulfil, by their distances to one leader.

    They differ in at most (size + other_size) * (100 - percent) / (100 + percent) elements, and so do their
    sizes and their distances to any third set.
    """
    most = (F.col("size") + F.col("other_size")) * (100 - percent)
    return (F.abs(F.col("size") - F.col("other_size")) * (100 + percent) <= most) & (
        F.abs(F.col("apart") - F.col("other_apart")) * (100 + percent) <= most)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                       percent: int = PERCENT, workspace: Workspace | None = None, keep: bool = False) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links).

    Null, empty and blank texts have no shingles and link with nothing. Equal sets always link. Repeated
    rows and ids are kept; a null id is a row like any other but never a component's name, unless its
    component has no other id. An empty table gives an empty one; other columns are not read.
    """
    spark = df.sparkSession
    store = workspace or Workspace(spark)
    source = id_and_text(df, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    # a set of n shingles has about n * 4 * (100 - percent) / (100 + percent) signatures; a word takes some six bytes
    total = (source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6 * 4.3 * (100 - percent) / (100 + percent)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // SHARD_ENTRIES) + 1)
    # the row's number decides which of a node's rows lends its text
    scanned = store.freeze(source.mapInArrow(
        _members(size, percent, shards), f"id {kind}, n long, node long, body binary, shard int, sigs binary, places binary, nodes binary").withColumn(
        "row", F.monotonically_increasing_id()), "scanned")
    members = scanned.filter("shard IS NULL").select("id", "n", "node", "body", "row")
    filled = members.filter("node IS NOT NULL")
    signed = scanned.filter("shard IS NOT NULL").select("shard", "sigs", "places", "nodes")
    buckets = store.freeze(signed.repartition(shards, "shard").groupBy("shard").applyInArrow(_buckets, "sig long, node long, size long"), "buckets")

    weights = store.freeze(buckets.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    firsts = filled.groupBy("node").agg(F.min("row").alias("row")).join(weights, "node", "left_semi")
    bodies = store.freeze(members.select("row", "node", "body").join(firsts.select("row"), "row", "left_semi").select("node", "body"), "bodies")

    def links(pairs: DataFrame) -> DataFrame:
        left = bodies.select(F.col("node").alias("a"), F.col("body").alias("p"))
        right = bodies.select(F.col("node").alias("b"), F.col("body").alias("q"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(linked_pairs(size, percent), "a long, b long")

    leaders = buckets.join(weights, "node").groupBy("sig").agg(F.max(F.struct("weight", "node"))["node"].alias("leader"))
    led = store.freeze(leaders, "leaders")
    pairs = buckets.join(led, "sig").filter("node <> leader").select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    found = store.freeze(links(pairs), "links")
    groups = connected(found, store)

    def placed(rows: DataFrame, node: str = "node") -> DataFrame:
        return rows.join(groups.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))

    # buckets of three or more nodes that lie in two or more components have pairs that were not tried
    still = placed(buckets.filter("size > 2")).groupBy("sig").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("sig")
    parted = buckets.join(still, "sig", "left_semi").join(led, "sig").filter("node <> leader").select("leader", "node").distinct()
    both = parted.join(bodies.select(F.col("node").alias("leader"), F.col("body").alias("p")), "leader").join(
        bodies.select("node", F.col("body").alias("q")), "node").select("leader", "node", "p", "q")
    apart = store.freeze(both.mapInArrow(differences(size, percent), DIFFERENCES), "apart")
    rarity = apart.groupBy("leader", "element").agg(F.count("*").alias("times"))
    within = may_link(percent)
    rarest = F.row_number().over(Window.partitionBy("leader", "node").orderBy("times", "element"))
    sought = placed(apart.join(rarity.filter("times > 1"), ["leader", "element"], "left").withColumn("times", F.coalesce("times", F.lit(1))).withColumn(
        "rank", rarest).filter("rank <= needed AND times > 1").select("leader", "element", "node", "size", "apart")).withColumnRenamed("component", "c")
    offered = placed(apart.filter("NOT linked").select("leader", "element", F.col("node").alias("other"), "size", "apart"), "other")
    offered = offered.withColumnsRenamed({"size": "other_size", "apart": "other_apart"})
    meeting = sought.join(offered, ["leader", "element"]).filter("c <> component").filter(within).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    more = store.freeze(links(meeting), "links")
    if not more.isEmpty():
        groups = connected(found.unionByName(more), store)
    rows = filled.select("id", "node")
    least = rows.groupBy("node").agg(F.min("id").alias("least"))
    by_group = placed(least).groupBy("component").agg(F.min("least").alias("component_id"))
    names = store.freeze(placed(least).join(by_group, "component").select("node", "component_id"), "names")
    chosen = members.join(names, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return chosen
