"""Joins that need a plan of their own: Hamming bands, intervals, as-of, pairing, dominance."""

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import hamming
from quern.session import spill

#: Blocks of a code in which a bucket's members agree.
AGREEING = 3
#: Points of a front that every task holds at once.
FRONT_BLOCK = 50_000


def _masks(distance: int, agreeing: int) -> list[int]:
    """Bits of each choice of agreeing ones among distance + agreeing blocks: codes within the distance agree in one of them."""
    blocks = distance + agreeing
    edges = [i * 64 // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in itertools.combinations(range(blocks), agreeing)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _banded(classes: DataFrame, code: str, distance: int, side: str, agreeing: int = AGREEING) -> DataFrame:
    """Each class once for each mask, with the bits of its code under it: 32 of them at distance 3 and 21 at distance 6, so that
    a bucket stays small where the codes are many."""
    parts = F.array(*[F.col(code).bitwiseAND(F.lit(m)) for m in _masks(distance, agreeing)])
    banded = classes.select("*", F.posexplode(parts).alias("block", "bits"))
    return banded.select("block", "bits", *[F.col(c).alias(f"{c}_{side}") for c in classes.columns])


def hamming_pairs(rows: DataFrame, key: str, code: str, distance: int, keep: list[str] | None = None, members: bool = False) -> DataFrame:
    """Pairs (a < b) of 64-bit codes within a Hamming distance.

    Pigeonhole: codes cut into distance + AGREEING blocks agree in at least AGREEING. Equal codes are joined once as a class and come out
    by their representative (smallest key), with the class size, so copies aren't multiplied. members: also a row
    (representative, member) at distance 0 for every other member of a class, so that each row's class can be told."""
    coded = rows.where(F.col(code).isNotNull())
    classes = coded.groupBy(code).agg(F.min(key).alias("rep"), F.count("*").alias("size"))
    a, b = _banded(classes, code, distance, "a"), _banded(classes, code, distance, "b")
    near = a.join(b, ["block", "bits"]).where((F.col("rep_a") < F.col("rep_b")) & (hamming(F.col(f"{code}_a"), F.col(f"{code}_b")) <= distance))
    pairs = near.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "size_a", "size_b", hamming(F.col(f"{code}_a"), F.col(f"{code}_b")).alias("distance")).distinct()
    if not members:
        return pairs
    own = coded.select(key, code).join(classes.where("size > 1"), code).where(F.col(key) != F.col("rep"))
    return pairs.unionByName(own.select(F.col("rep").alias("a"), F.col(key).alias("b"), F.col("size").alias("size_a"), F.col("size").alias("size_b"), F.lit(0).alias("distance")))


def hamming_guard(rows: DataFrame, guarded: DataFrame, key: str, code: str, distance: int) -> DataFrame:
    """(key, near, distance): each row whose code is equal to one of the guarded rows or within a Hamming distance, with the
    nearest of these (smallest key of equally near ones). Codes meet once, however many rows have them."""
    held = guarded.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(key).alias("rep"))
    own = rows.where(F.col(code).isNotNull()).select(code).distinct()
    apart = hamming(F.col(f"{code}_a"), F.col(f"{code}_b"))
    near = _banded(own, code, distance, "a").join(_banded(held, code, distance, "b"), ["block", "bits"]).where(apart <= distance)
    best = near.groupBy(F.col(f"{code}_a").alias(code)).agg(F.min(F.struct(apart.alias("distance"), F.col("rep_b").alias("near"))).alias("m"))
    return rows.join(best, code).select(key, "m.near", "m.distance")


def valid_at(edges: DataFrame, at: Column) -> DataFrame:
    """Edges whose half-open interval holds at; a null end is open."""
    return edges.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (at < F.col("valid_until"))))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, ts: str) -> DataFrame:
    """Each point with the interval of its key that holds it: the intervals of a key don't overlap, so it is an as-of join."""
    met = as_of_join(points, intervals, key, ts, "valid_from", ["valid_from", "valid_until", *[c for c in intervals.columns if c not in (key, "valid_from", "valid_until")]])
    return met.where("valid_from is not null and (valid_until is null or " + f"`{ts}` < valid_until)")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, take: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before it: one union, one shuffle, one ordered window."""
    lefts = left.select("*", F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__right"))
    rights = right.select(*[F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(*take).alias("__right"))
    w = Window.partitionBy(key).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rights.unionByName(lefts).withColumn("__right", F.last("__right", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *[F.col("__right")[c].alias(c) for c in take])


def pair_kth(starts: DataFrame, ends: DataFrame, keys: list[str], ts: str, order: list[str]) -> DataFrame:
    """The k-th start of a key with its k-th end."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    s = starts.select(*keys, F.col(ts).alias("started"), F.row_number().over(w).alias("k"))
    e = ends.select(*keys, F.col(ts).alias("ended"), F.row_number().over(w).alias("k"))
    return s.join(e, [*keys, "k"])


def _dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points another one matches in all measures and beats in one."""
    out = np.zeros(len(points), dtype=bool)
    for i in range(0, len(points), 256):
        part = points[i : i + 256, None, :]
        out[i : i + 256] = ((by[None] >= part).all(axis=2) & (by[None] > part).any(axis=2)).any(axis=1)
    return out


def pareto(rows: DataFrame, key: str, maximise: list[str]) -> DataFrame:
    """Rows that no other row matches in all measures and beats in one; rows with a null measure are left out.

    Each task first drops what its own points dominate; what is left is compared with all of what is left, FRONT_BLOCK points at
    a time, so no task holds a front that grows with the data."""
    kind = ", ".join(f"`{c}` double" for c in maximise)
    points = rows.select(*[F.col(c).cast("double").alias(c) for c in maximise]).dropna().distinct()

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = np.zeros((0, len(maximise)))
        for df in frames:
            for i in range(0, len(df), 2000):
                part = df.iloc[i : i + 2000].to_numpy()
                part = part[~_dominated(part, part)]
                part = part[~_dominated(part, front)]
                if len(part):
                    front = np.concatenate([front[~_dominated(front, part)], part])
        yield pd.DataFrame(front, columns=maximise)

    left, _ = spill(points.mapInPandas(local, kind).withColumn("__at", F.monotonically_increasing_id()), "front")
    n = left.count()
    blocks = max(1, -(-n // FRONT_BLOCK))
    kept = left
    for b in range(blocks):
        held = np.array([list(r) for r in left.where(F.pmod(F.xxhash64("__at"), F.lit(blocks)) == b).select(*maximise).collect()]).reshape(-1, len(maximise))

        def against(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for df in frames:
                yield df[~_dominated(df[maximise].to_numpy(), held)]

        kept = kept.mapInPandas(against, kind + ", __at bigint")
    front = kept.select(*[F.col(c).alias(f"__{c}") for c in maximise])
    return rows.join(front, [F.col(c).cast("double") == F.col(f"__{c}") for c in maximise], "left_semi")


def compare_reports(before: DataFrame, after: DataFrame, key: str, passed: str) -> DataFrame:
    """regression, improvement, missing and new cases of two reports."""
    b, a = before.select(key, F.col(passed).alias("was")), after.select(key, F.col(passed).alias("is"))
    joined = b.join(a, key, "full_outer")
    change = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") & ~F.col("is"), "regression").when(~F.col("was") & F.col("is"), "improvement")
    return joined.select(key, change.alias("change")).where("change is not null")


def contains_rows(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Rows of parent that child lacks, with multiplicity."""
    return parent.exceptAll(child.select(*parent.columns))


def best_per_id(parts: list[DataFrame], key: str, score: str) -> DataFrame:
    """Union of scored candidates, each key with its best score."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.max(score).alias(score))


def pairwise_agreement(rows: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Share of unordered pairs of a group that agree, from counts of equal values: no pair is built."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    sums = counts.groupBy(group).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("agreeing"), F.sum("c").alias("n"))
    return sums.where("n >= 2").select(group, "n", (F.col("agreeing") / (F.col("n") * (F.col("n") - 1) / 2)).alias("agreement"))
