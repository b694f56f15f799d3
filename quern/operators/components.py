"""Graphs as edge tables: components, closure, paths. Loops run over tables in the shared folder; the driver sees counts only."""

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import drop_spill, spill


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component of the undirected edges (u, v), by label spreading with pointer
    jumping: a node takes the least label of itself and its neighbours, then the label of its label."""
    spark = edges.sparkSession
    both, edge_path = spill(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label, path = spill(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    state = None
    for _ in range(max_rounds):
        seen = both.join(label, both["v"] == label["node"]).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = label.join(seen, "node").select("node", F.least("root", "near").alias("root"))
        jumped = hooked.join(label.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root"))
        after, new_path = spill(jumped, "labels")
        drop_spill(spark, path)
        label, path = after, new_path
        now = tuple(label.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).head())
        if now == state:
            drop_spill(spark, edge_path)
            return label
        state = now
    raise RuntimeError("components aren't stable")


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None, undirected: bool = False) -> DataFrame:
    """(node, depth): what can be reached from the start nodes over edges (u, v), each with its least depth, up to a depth if one
    is asked for; cycles end. A round for each depth, until one finds nothing new."""
    spark = edges.sparkSession
    step = edges.select("u", "v")
    if undirected:
        step = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen, path = spill(start.select("node", F.lit(0).alias("depth")).distinct(), "reached")
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        new = seen.where(F.col("depth") == depth - 1).join(step, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        after, new_path = spill(seen.unionByName(new), "reached")
        drop_spill(spark, path)
        seen, path = after, new_path
        if seen.where(F.col("depth") == depth).isEmpty():
            break
    return seen


def impact(edges: DataFrame, removed: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """What follows from removed records, counted by the kind that a prefix of its name tells."""
    reached = reachable(edges, removed).where("depth > 0")
    kind = F.lit("record")
    for prefix, name in prefixes.items():
        kind = F.when(F.col("node").cast("string").startswith(prefix), name).otherwise(kind)
    return reached.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
