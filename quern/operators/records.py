"""The record store and the making of datasets: search, selection with reasons, quotas, splits, checks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import hash_unit


def search(rows: DataFrame, equals: dict | None = None, contains: dict | None = None, prefix: dict | None = None, since=None, until=None, ts: str = "", order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Conjunction of predicates: equality, substring without letter case, dotted prefix (a or a.*), and a time range."""
    for c, v in (equals or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        rows = rows.where(F.contains(F.lower(F.col(c)), F.lit(v.lower())))
    for c, v in (prefix or {}).items():
        rows = rows.where((F.col(c) == v) | F.col(c).startswith(f"{v}."))
    if since is not None:
        rows = rows.where(F.col(ts) >= since)
    if until is not None:
        rows = rows.where(F.col(ts) < until)
    if order:
        rows = rows.orderBy(*order)
    return rows.limit(limit) if limit else rows


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that a row fails, or null; a null check fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks])


def without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the removed ones."""
    return rows.join(removed.select(key).distinct(), key, "left_anti")


def ranked_by_hash(rows: DataFrame, keys: list[str], row_id: str, seed: str) -> DataFrame:
    """rank within keys in an order drawn by hash: the same for the same seed on any cluster."""
    w = Window.partitionBy(*keys).orderBy(F.sha2(F.concat(F.lit(seed), F.col(row_id).cast("string")), 256), row_id)
    return rows.withColumn("rank", F.row_number().over(w))


def quota(rows: DataFrame, key: str, mix: dict[str, float], row_id: str, seed: str = "s") -> DataFrame:
    """As many rows as the scarcest bucket allows, with the shares of the mix; a bucket that is missing is an error."""
    counts = {r[key]: r["count"] for r in rows.where(F.col(key).isin(*mix)).groupBy(key).count().collect()}  # one row a bucket of the mix
    missing = sorted(set(mix) - set(counts))
    if missing:
        raise ValueError(f"no rows for {missing}")
    n = min(int(counts[k] / w) for k, w in mix.items())
    take = F.lit(0)
    for k, w in mix.items():
        take = F.when(F.col(key) == k, max(1, round(n * w))).otherwise(take)
    return ranked_by_hash(rows.where(F.col(key).isin(*mix)), [key], row_id, seed).where(F.col("rank") <= take).drop("rank")


def synthetic_cap(rows: DataFrame, is_synthetic: Column, most: float, row_id: str, seed: str = "s") -> DataFrame:
    """Synthetic rows up to a share of all rows that are left, those with the least hashes. Counts by the first 16 bits of the
    hash (65,536 at most) tell which rows stay; only those of the one head where the cap falls are ranked."""
    h = F.sha2(F.concat(F.lit(seed), F.col(row_id).cast("string")), 256)
    head = F.substring(h, 1, 4)
    cap = int(most / (1 - most) * rows.where(~is_synthetic).count())
    border, room = "g", 0  # behind all heads
    for r in sorted(rows.where(is_synthetic).groupBy(head.alias("head")).count().collect()):
        if r["count"] > cap:
            border, room = r["head"], cap
            break
        cap -= r["count"]
    drawn = rows.where(is_synthetic & (head < border))
    last = rows.where(is_synthetic & (head == border)).withColumn("__rank", F.row_number().over(Window.partitionBy(head).orderBy(h, row_id))).where(F.col("__rank") <= room).drop("__rank")
    return rows.where(~is_synthetic).unionByName(drawn).unionByName(last)


def family_split(rows: DataFrame, family: Column, weights: dict[str, float], seed: str) -> DataFrame:
    """A split for each family, by the place of its hash on the cumulated weights."""
    h, at = hash_unit(F.concat(F.lit(f"{seed}:"), family)), 0.0
    split, total = None, sum(weights.values())
    for name, w in weights.items():
        at += w / total
        split = F.when(h < at, name) if split is None else split.when(h < at, name)
    return rows.withColumn("split", split.otherwise(name))


def leakage(rows: DataFrame, content: str, split: str) -> DataFrame:
    """Contents that occur in more than one split."""
    return rows.groupBy(content).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(split)).alias("splits")).where("size(splits) > 1")


def snapshot_hash(rows: DataFrame, key: str, status: str) -> DataFrame:
    """(rows, hash): one hash of the sorted hashes of (key, status). They are joined and hashed by their first four digits, those
    hashes by the first two, and these once more, so that a task holds a 65,536th of them."""
    line = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.coalesce(F.col(status).cast("string"), F.lit(""))), 256)
    level = rows.select(line.alias("h"), F.substring(line, 1, 4).alias("b"), F.lit(1).alias("n"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256)
    for digits in (4, 2, 0):
        order = F.col("h") if digits == 4 else F.col("b")
        level = level.withColumn("o", order).groupBy(F.substring("b", 1, digits).alias("b")).agg(joined.alias("h"), F.sum("n").alias("n"))
    return level.select(F.col("n").alias("rows"), F.col("h").alias("hash"))


def round_robin(rows: DataFrame, key: str, row_id: str, budget: int, seed: str = "s") -> DataFrame:
    """Rows taken in turn from each key until the budget is spent."""
    return ranked_by_hash(rows, [key], row_id, seed).orderBy("rank", key).limit(budget)


def reserve(rows: DataFrame, keys: list[str], row_id: str, k: int) -> DataFrame:
    """The first k rows of each subtype are reserved, the rest isn't."""
    w = Window.partitionBy(*keys).orderBy(row_id)
    return rows.withColumn("reserved", F.row_number().over(w) <= k)


def attribution(rows: DataFrame, licence: str, source: str) -> DataFrame:
    return rows.where(F.col(licence).isNotNull()).groupBy(licence).agg(F.array_join(F.array_sort(F.collect_set(source)), "; ").alias("sources"), F.count("*").alias("n"))


def licence_ids(c: Column) -> Column:
    """The names in a licence expression, without OR, AND and WITH; a name has a capital or a digit."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[;,()\s]+"), lambda x: (x != "") & ~x.isin("OR", "AND", "WITH") & x.rlike("[A-Z0-9]")))
