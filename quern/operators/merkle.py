"""Merkle roots of ordered hashes: each level is one grouped join of neighbours, so no stream is held by one task. Proofs of whole
streams are checked by blocks of leaves, so that neither nodes nor proofs are written or shuffled."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import spill


def merkle_root(leaves: DataFrame, stream: str, pos: str, leaf: str) -> DataFrame:
    """(stream, root): SHA-256 over the concatenated hashes of neighbours; the last of an odd level is doubled.

    Positions count from 0 without gaps. The number of levels is the logarithm of the longest stream."""
    level = leaves.select(stream, F.col(pos).cast("bigint").alias("pos"), F.col(leaf).alias("h"))
    level = level.join(level.groupBy(stream).agg(F.max("pos").alias("most")), stream)
    longest = level.agg(F.max("most")).head()[0]
    while longest is not None and longest > 0:
        pairs = level.groupBy(stream, "most", F.floor(F.col("pos") / 2).alias("parent")).agg(F.min_by("h", "pos").alias("left"), F.max_by("h", "pos").alias("right"))
        level = pairs.select(stream, F.col("parent").alias("pos"), F.when(F.col("most") == 0, F.col("left")).otherwise(F.sha2(F.concat("left", "right"), 256)).alias("h"), F.floor(F.col("most") / 2).alias("most"))
        longest //= 2
    return level.select(stream, F.col("h").alias("root"))


def merkle_levels(leaves: DataFrame, stream: str, pos: str, leaf: str) -> DataFrame:
    """(stream, level, pos, h): all nodes of the trees, the leaves at level 0; written level by level."""
    level, _ = spill(leaves.select(stream, F.lit(0).alias("level"), F.col(pos).cast("bigint").alias("pos"), F.col(leaf).alias("h")), "merkle")
    out, n = level, 0
    while not level.where("pos > 0").isEmpty():
        parents = level.groupBy(stream, F.floor(F.col("pos") / 2).alias("pos")).agg(F.min_by("h", "pos").alias("a"), F.max_by("h", "pos").alias("b"))
        tops = level.groupBy(stream).agg(F.max("pos").alias("most")).where("most > 0").select(stream)  # a finished tree has no more levels
        n += 1
        level, _ = spill(parents.join(tops, stream).select(stream, F.lit(n).alias("level"), "pos", F.sha2(F.concat("a", "b"), 256).alias("h")), "merkle")
        out = out.unionByName(level)
    return out


def merkle_proofs(levels: DataFrame, stream: str) -> DataFrame:
    """(stream, pos, leaf, proof): for each leaf its neighbours on the way to the root, with the side on which they stand. The
    last of an odd level is its own neighbour."""
    height = levels.groupBy(stream).agg(F.max("level").alias("height"))
    ends = levels.groupBy(stream, "level").agg(F.max("pos").alias("end"))
    leaves = levels.where("level = 0").select(stream, F.col("pos").alias("leaf_pos"), F.col("h").alias("leaf"))
    way = leaves.join(height, stream).select(stream, "leaf_pos", "leaf", F.explode_outer(F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1))).alias("level"))
    at = way.withColumn("p", F.floor(F.col("leaf_pos") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint"))
    beside = at.join(ends, [stream, "level"], "left").withColumn("pos", F.least(F.col("p").bitwiseXOR(F.lit(1)), F.col("end")))
    met = beside.join(levels, [stream, "level", "pos"], "left")
    step = F.when(F.col("level").isNotNull(), F.struct("level", "h", (F.col("p") % 2 == 1).alias("left")))
    return met.groupBy(stream, F.col("leaf_pos").alias("pos"), "leaf").agg(F.array_sort(F.collect_list(step)).alias("proof"))


def proven(leaf: Column, proof: Column) -> Column:
    """The root to which a proof leads from a leaf."""
    return F.aggregate(proof, leaf, lambda h, s: F.when(s["left"], F.sha2(F.concat(s["h"], h), 256)).otherwise(F.sha2(F.concat(h, s["h"]), 256)))


def placed(rows: DataFrame, stream: str, order: str) -> DataFrame:
    """rows with pos: their places in their streams by order, from 0. Streams are cut into ranges, so none is sorted by one task."""
    ranged = rows.repartitionByRange(stream, order).sortWithinPartitions(stream, order).withColumn("__at", F.monotonically_increasing_id())
    ranged, _ = spill(ranged, "ranged")
    part = F.shiftright("__at", 33).alias("__part")
    runs = ranged.groupBy(part, F.col(stream).alias("__stream")).agg(F.min("__at").alias("__first"), F.count("*").alias("n"))
    runs = runs.withColumn("__before", F.sum("n").over(Window.partitionBy("__stream").orderBy("__part")) - F.col("n")).drop("n")
    runs, _ = spill(runs, "runs")  # its size is known to the join: a row for each range and stream
    here = (part == runs["__part"]) & ranged[stream].eqNullSafe(runs["__stream"])
    return ranged.join(runs, here).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"))


#: Leaves of a block: 2 to the power of BLOCK.
BLOCK = 4


def _parent(a: bytes | None, b: bytes | None) -> bytes | None:
    return None if a is None or b is None else hashlib.sha256(a + b).hexdigest().encode()


def block_levels(leaves: list[bytes | None], height: int) -> list[list[bytes | None]]:
    """The nodes over a block's leaves, level by level; the last of an odd level is doubled."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([_parent(a, b) for a, b in zip(below[::2], [*below[1::2], below[-1]])])
    return levels


def block_proof(levels: list[list[bytes | None]], i: int) -> list[tuple[bytes | None, bool]]:
    """The neighbours of leaf i on the way to the top of its block, and whether they stand on the left."""
    return [(level[min((i >> k) ^ 1, len(level) - 1)], bool(i >> k & 1)) for k, level in enumerate(levels[:-1])]


def leads_to(leaf: bytes | None, proof: list[tuple[bytes | None, bool]]) -> bytes | None:
    for h, left in proof:
        leaf = _parent(h, leaf) if left else _parent(leaf, h)
    return leaf


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of nodes sorted by stream and place, blocks whole: a row for each block. A block goes on in the next batch."""

    def blocks(rows: pa.Table, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        own, leaves, proven = (rows.column(c).combine_chunks().to_pylist() for c in ("h", "leaves", "proven"))
        pos = rows.column("pos").combine_chunks().take(pa.array(begins)).to_numpy() >> BLOCK
        tops, all_, good = [], [], []
        for b, e, block in zip(begins.tolist(), ends.tolist(), pos.tolist()):
            nodes = [h and h.encode() for h in own[b:e]]
            # only a stream of one block ends below the height of a block
            levels = block_levels(nodes, (len(nodes) - 1).bit_length() if block == 0 else BLOCK)
            top = levels[-1][0]
            tops.append(top and top.decode())
            all_.append(sum(leaves[b:e]))
            good.append(sum(proven[b + i] for i, h in enumerate(nodes) if top is not None and leads_to(h, block_proof(levels, i)) == top))
        return pa.RecordBatch.from_arrays([rows.column("stream").combine_chunks().take(pa.array(begins)), pa.array(pos), pa.array(tops, pa.string()), pa.array(all_, pa.int64()), pa.array(good, pa.int64())], names=["stream", "pos", "h", "leaves", "proven"])

    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        rows = new if held is None else pa.concat_tables([held, new])
        if not len(rows):
            continue
        stream = rows.column("stream").combine_chunks().dictionary_encode("encode").indices.to_numpy()
        block = rows.column("pos").combine_chunks().to_numpy() >> BLOCK
        begins = np.flatnonzero(np.append(True, (np.diff(stream) != 0) | (np.diff(block) != 0)))
        if len(begins) > 1:
            yield blocks(rows, begins[:-1], begins[1:])
        held = rows.slice(int(begins[-1]))
    if held is not None:
        yield blocks(held, np.array([0]), np.array([len(held)]))


def proven_leaves(leaves: DataFrame, stream: str, pos: str, leaf: Column) -> DataFrame:
    """(stream, root, leaves, proven): leaves whose proof leads to the root of their stream. Positions count from 0 without gaps.

    The leaves of a block of 16 share the upper part of their proofs. Each leaf is led to the top of its block; then the tops are
    the leaves of a smaller tree and stand for as many leaves as were led to them, until each stream is one node. The leaf is
    worked out after the shuffle, so what it is made from is moved, once, and of the nodes only tops are written."""
    kind = leaves.schema[stream].dataType.simpleString()
    out = f"stream {kind}, pos bigint, h string, leaves bigint, proven bigint"
    nodes = leaves.withColumnsRenamed({stream: "stream", pos: "pos"}).withColumn("pos", F.col("pos").cast("bigint"))
    one = F.lit(1).cast("bigint")
    columns = [leaf.cast("string").alias("h"), one.alias("leaves"), one.alias("proven")]
    while True:
        sorted_ = nodes.repartition("stream", F.shiftright("pos", BLOCK)).sortWithinPartitions("stream", "pos")
        nodes, _ = spill(sorted_.select("stream", "pos", *columns).mapInArrow(_checked, out), "tops")
        if nodes.where("pos > 0").isEmpty():
            return nodes.select(F.col("stream").alias(stream), F.col("h").alias("root"), "leaves", "proven")
        columns = ["h", "leaves", "proven"]
