"""Top-k retrieval: a stated query set against all rows, in blocks."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one multiplication, and queries that a task holds at once.
BLOCK, HELD = 4096, 65_536


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector or unequal lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def _against(queries: DataFrame, rows: DataFrame, key: str, vector: str, select, space: str | None = None, block: int = HELD) -> DataFrame:
    """(query_id, id, similarity) of what select(scores of a block of queries and a batch of rows) picks.

    Tasks hold block query vectors at once (a bounded broadcast) and multiply each batch of rows with BLOCK of them at a time, so
    the rows are read once for block queries, and what is shuffled is what was picked. A vector of another length than the
    query's is no candidate; null vectors are left out. space: a column in which both have to be equal."""
    spark = rows.sparkSession
    named = lambda df, name: df.where(F.col(vector).isNotNull()).select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v"), (F.col(space).cast("string") if space else F.lit("")).alias("space"))
    asked = named(queries, "query_id")
    passes = max(1, -(-asked.count() // block))
    kind, query_kind = (df.schema[key].dataType.simpleString() for df in (rows, queries))
    out = None
    for p in range(passes):
        held = (asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)).collect()
        by_length: dict[int, list] = {}
        for r in held:
            by_length.setdefault(len(r["v"]), []).append(r)
        shared = spark.sparkContext.broadcast({n: ([r["query_id"] for r in rs], np.array([r["space"] for r in rs], dtype=object), _unit(np.array([r["v"] for r in rs], dtype=np.float64).reshape(len(rs), n))) for n, rs in by_length.items()})

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for df in frames:
                for n, own in df.groupby(df["v"].map(len)):
                    if n not in shared.value:
                        continue
                    ids, spaces, matrix = shared.value[n]
                    vectors, names, there = _unit(np.stack(own["v"].to_numpy()).reshape(len(own), n)), own["id"].to_numpy(), own["space"].to_numpy()
                    for i in range(0, len(ids), BLOCK):
                        scores = matrix[i : i + BLOCK] @ vectors.T
                        if space:
                            scores = np.where(spaces[i : i + BLOCK, None] == there[None], scores, -np.inf)
                        q, r = select(scores)
                        keep = np.isfinite(scores[q, r])
                        q, r = q[keep], r[keep]
                        yield pd.DataFrame({"query_id": [ids[i + x] for x in q], "id": names[r], "similarity": scores[q, r]})

        part = named(rows, "id").mapInPandas(run, f"query_id {query_kind}, id {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def cosine_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = HELD, space: str | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): the k most similar other rows of each query, of the same space if a column is named;
    ties by key. k + 1 rows of each query and
    batch are shuffled, and more only where they tie with the last of these."""

    def best(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if scores.shape[1] <= k + 1:
            return np.nonzero(np.ones(scores.shape, dtype=bool))
        return np.nonzero(scores >= np.partition(scores, -(k + 1), axis=1)[:, -(k + 1), None])

    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = _against(queries, rows, key, vector, best, space, block).where("query_id <> id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias(key), "similarity", "rank")


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def similar(queries: DataFrame, rows: DataFrame, key: str, vector: str, least: float, space: str | None = None) -> DataFrame:
    """(query_id, key, similarity) of all rows with at least a cosine to a query, the query's own row too, in the same space if a
    column of spaces is named."""
    found = _against(queries, rows, key, vector, lambda scores: np.nonzero(scores >= least), space)
    return found.select("query_id", F.col("id").alias(key), "similarity")


def rerank(candidates: DataFrame, weights: dict[str, float], recency_days: Column, least: float, k: int, query: str | None = None) -> DataFrame:
    """Hybrid score: a weighted sum of columns and 0.1 / (1 + days / 30), over candidates of at least a similarity; the k best,
    of each query if its column is named. Ties by the first column."""
    score = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0)) + 0.10 / (1 + recency_days / 30)
    order = [F.desc("score"), *[c for c in candidates.columns[:1]]]
    scored = candidates.where(F.col("similarity") >= least).withColumn("score", score)
    if query is None:
        return scored.orderBy(*order).limit(k)
    return scored.withColumn("__rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")
