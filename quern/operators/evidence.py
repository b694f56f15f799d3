"""Folds over evidence, beliefs, deliveries and features: grouped expressions, no state beside the groups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_fold(rows: DataFrame, keys: list[str], since: Column, ts: str, agreed: Column, failed: Column, latency: str) -> DataFrame:
    """Rows behind a point in time: how many, the agreement over those that answered, the failures, and the 95th percentile of
    the latency (nearest rank)."""
    new = rows.where(F.col(ts) > since)
    return new.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(agreed.cast("double")).alias("agreement"), F.avg(F.coalesce(failed, F.lit(False)).cast("double")).alias("failing"), F.expr(f"percentile_disc(0.95) within group (order by `{latency}`)").alias("p95"))


def conflicts(beliefs: DataFrame, keys: list[str], value: str, confidence: str, least: float) -> DataFrame:
    """Keys for which more than one value has a confidence, with their number and the gap between the best two."""
    w = Window.partitionBy(*keys).orderBy(F.desc(confidence), value)
    held = beliefs.where(F.col(confidence) >= least).withColumn("__rank", F.row_number().over(w))
    best = lambda k: F.max(F.when(F.col("__rank") == k, F.col(confidence)))
    return held.groupBy(*keys).agg(F.count("*").alias("values"), (best(1) - best(2)).alias("gap"), F.max(F.when(F.col("__rank") == 1, F.col(value))).alias("leading")).where("values > 1")


def strict_wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of the Wilson interval with the exact normal quantile; an error without observations."""
    p, z2 = successes / n, z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (centre - spread) / (1 + z2 / n), (centre + spread) / (1 + z2 / n)
    checked = F.when(n > 0, F.lit(True)).otherwise(F.raise_error(F.lit("an interval needs observations")).cast("boolean"))
    return F.when(checked, F.struct(low.alias("low"), high.alias("high")))


def gaussian_epsilon(sensitivity: Column, sigma: Column, delta: float, rounds: Column) -> Column:
    """Privacy loss of repeated Gaussian releases by basic composition (Dwork & Roth 2014)."""
    return rounds * sensitivity * F.sqrt(2 * F.log(F.lit(1.25 / delta))) / sigma


def delivery_fold(attempts: DataFrame, key: str, ts: str, done: Column, most: int, base_s: float) -> DataFrame:
    """(key, attempts, state, next_at): deliveries from the log of their attempts: delivered once an attempt succeeded, dead after
    so many failures, else due again after a pause that doubles with each failure."""
    folded = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.max(F.coalesce(done, F.lit(False))).alias("done"), F.max(ts).alias("last"))
    state = F.when(F.col("done"), "delivered").when(F.col("attempts") >= most, "dead").otherwise("waiting")
    pause = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(base_s) * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("decimal(18,6)"))
    return folded.select(key, "attempts", state.alias("state"), F.when(state == "waiting", F.col("last") + pause).alias("next_at"))


def retained(rows: DataFrame, keys: list[str], order: list[Column], keep: int, ts: str, oldest: Column) -> DataFrame:
    """The newest rows of each key, up to a number and an age."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.where(F.col(ts) >= oldest).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def agreed_by(reviews: DataFrame, key: str, reviewer: str, label: str, least: int = 2) -> DataFrame:
    """Keys with enough distinct reviewers who all gave the same label."""
    return reviews.where(F.col(label).isNotNull() & F.col(reviewer).isNotNull()).groupBy(key).agg(F.countDistinct(reviewer).alias("reviewers"), F.countDistinct(label).alias("labels"), F.min(label).alias("label")).where((F.col("reviewers") >= least) & (F.col("labels") == 1)).select(key, "reviewers", "label")


def contains_map(stored: Column, wanted: dict[str, str]) -> Column:
    """Whether a map has all the wanted entries."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(stored, F.lit(k)) == F.lit(v), F.lit(False))
    return out


def best_fit(models: DataFrame, nodes: DataFrame, model: str, node: str, memory: str, room: str) -> DataFrame:
    """(model, node, room): for each model the node with the least room that is enough, the first by name of equals.

    Both sides are ordered by size in one union, and a model takes the next node behind it: an as-of join forward, without pairs."""
    asked = models.select(F.col(memory).cast("double").alias("size"), F.lit(0).alias("side"), F.col(model).alias("model"), F.lit(None).cast("string").alias("node"))
    offered = nodes.groupBy(F.col(room).cast("double").alias("size")).agg(F.min(node).alias("node")).select("size", F.lit(1).alias("side"), F.lit(None).cast("string").alias("model"), "node")
    step = F.ceil(F.log2(F.greatest("size", F.lit(1.0)))).cast("int")
    both = asked.unionByName(offered).withColumn("step", step)
    ahead = Window.partitionBy("step").orderBy("size", "side").rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("hit", F.first(F.when(F.col("side") == 1, F.struct("size", "node")), ignorenulls=True).over(ahead)).where("side = 0")
    smallest = offered.groupBy(step.alias("above")).agg(F.min(F.struct("size", "node")).alias("next"))  # one row a power of two
    fallback = near.where("hit is null").join(F.broadcast(smallest), F.col("above") > F.col("step")).groupBy("model", "size").agg(F.min("next").alias("hit"))
    found = near.where("hit is not null").select("model", "hit").unionByName(fallback.select("model", "hit"))
    return found.select(F.col("model").alias(model), F.col("hit.node").alias(node), F.col("hit.size").alias(room))


def sentences_kept(texts: DataFrame, key: str, text: str, classes: dict[str, str], most: int) -> DataFrame:
    """(key, class, pos, sentence): sentences by the first class whose shape they have, repeated ones once, at most so many of a
    class."""
    parts = texts.select(key, F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("pos", "sentence")).where("trim(sentence) <> ''")
    kind = F.coalesce(*[F.when(F.col("sentence").rlike(p), F.lit(name)) for name, p in classes.items()])
    first = parts.select(key, kind.alias("class"), "sentence", "pos").where("class is not null").groupBy(key, "class", "sentence").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy(key, "class").orderBy("pos")
    return first.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
