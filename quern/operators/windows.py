"""Ordered analytics: versions, chains, stages, folds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(log: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The last entry of each key by max_by with map-side combine; no sort of a key's whole history."""
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy(key.alias("__key")).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")


def as_of(log: DataFrame, key: Column, at: Column, until, order: list[Column]) -> DataFrame:
    """The state as it was at a time or offset: replay up to it, the last entry of each key wins."""
    return latest_version(log.where(at <= F.lit(until)), key, order)


def last_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Retention: the newest n rows of each key (order: newest first)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def stage_durations(events: DataFrame, key: str, ts: str, stage: str, order: list[Column]) -> DataFrame:
    """Seconds from each stage to the next one of the same key; the last stage has none."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.select(key, stage, F.col(ts).alias("started"), F.lead(ts).over(w).alias("ended")).where("ended is not null").withColumn("seconds", (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6)


def succession(facts: DataFrame, keys: list[str], valid_from: str, value: str, order: list[Column]) -> DataFrame:
    """Intervals of a functional fact: a new value closes the one before; a repeated value opens none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = facts.withColumn("__before", F.lag(value).over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col(value)))
    return changed.select(*keys, value, F.col(valid_from).alias("valid_from"), F.lead(valid_from).over(w).alias("valid_until"))


def ema(rows: DataFrame, keys: list[str], order: Column, value: str, alpha: float, start: float, block: int = 4096) -> DataFrame:
    """Exponential moving average after the last row, from a start value.

    The fold s <- (1 - a) s + a x is linear, so the result is a sum of weights (1 - a)^(rows after it): a window numbers the
    rows from the newest, and the sum has a map-side combine. No key's history is collected."""
    newest = Window.partitionBy(*keys).orderBy(order.desc())
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(newest) - 1).alias("age"))
    return ranked.groupBy(*keys).agg((F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("age")) * F.col(value)) + F.pow(F.lit(1 - alpha), F.count("*")) * start).alias("ema"), F.count("*").alias("n"))


def chain(rows: DataFrame, stream: str, order: list[Column], body: Column) -> DataFrame:
    """Entries with the hash of their body and position, for the check below."""
    w = Window.partitionBy(stream).orderBy(*order)
    return rows.select(stream, body.alias("body"), F.row_number().over(w).alias("seq")).withColumn("own_hash", F.sha2(F.concat_ws("|", F.col(stream), F.col("seq"), "body"), 256)).withColumn("previous_hash", F.coalesce(F.lag("own_hash").over(Window.partitionBy(stream).orderBy("seq")), F.lit("")))


def verify_chain(entries: DataFrame, stream: str) -> DataFrame:
    """First break of each stream: a gap in seq, a previous hash that doesn't match, or a body that doesn't hash to its own."""
    w = Window.partitionBy(stream).orderBy("seq")
    checked = entries.select(
        stream,
        "seq",
        F.when(F.col("seq") != F.coalesce(F.lag("seq").over(w), F.lit(0)) + 1, "gap")
        .when(F.col("previous_hash") != F.coalesce(F.lag("own_hash").over(w), F.lit("")), "previous")
        .when(F.col("own_hash") != F.sha2(F.concat_ws("|", F.col(stream), F.col("seq"), "body"), 256), "body")
        .alias("why"),
    )
    return checked.groupBy(stream).agg(F.count("*").alias("entries"), F.min(F.when(F.col("why").isNotNull(), F.struct("seq", "why"))).alias("broken")).select(stream, "entries", F.col("broken.seq").alias("broken_seq"), F.col("broken.why").alias("broken_why"))


def sequence_pairs(events: DataFrame, key: str, kind: str, order: list[Column], least: int) -> DataFrame:
    """How often one kind of event directly follows another within a key."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = events.select(F.lag(kind).over(w).alias("cause"), F.col(kind).alias("effect")).where("cause is not null")
    return pairs.groupBy("cause", "effect").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rolling_rate(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events of the key within the last so many seconds, at each event."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w))


def rank_beliefs(beliefs: DataFrame, keys: list[str], value: str, confidence: str, clear: float = 0.15, near: float = 0.25, sure: float = 0.9) -> DataFrame:
    """Of competing values the best is kept; others are obsolete if it is sure and clearly ahead, contested if near, else open."""
    best = F.max(confidence).over(Window.partitionBy(*keys))
    gap = best - F.col(confidence)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(confidence), value)) == 1
    status = F.when(first, "current").when((best >= sure) & (gap >= clear), "obsolete").when(gap < near, "contested").otherwise("open")
    return beliefs.select(*keys, value, confidence, status.alias("status"))


def running_budget(rows: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows in order as long as their sizes together stay within a budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
