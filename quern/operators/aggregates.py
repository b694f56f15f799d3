"""Operational analytics over runs, events and decisions: one shuffle each, with map-side combine."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import stats


def model_stats(runs: DataFrame) -> DataFrame:
    """Per model and task type: runs, success rate, mean latency and mean of the known quality."""
    q = stats.quality(F.col("user_feedback"), F.col("verifier_score"))
    return runs.groupBy("model_id", "task_type").agg(F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("latency_ms").alias("latency"), F.avg(q).alias("quality"))


def multi_granularity(runs: DataFrame) -> DataFrame:
    """Counts and sums of quality at two granularities at once: (task type, bucket, mode) and task type."""
    q = stats.quality(F.col("user_feedback"), F.col("verifier_score"))
    base = runs.select("task_type", stats.complexity_bucket(F.coalesce("complexity", F.lit(0.0))).alias("bucket"), F.coalesce("mode", F.lit("none")).alias("mode"), "model_id", q.alias("q"), "latency_ms").where("q is not null")
    return base.groupingSets([("task_type", "bucket", "mode", "model_id"), ("task_type", "model_id")], "task_type", "bucket", "mode", "model_id").agg(F.count("*").alias("n"), F.sum("q").alias("sum_q"), F.sum("latency_ms").alias("sum_ms"))


def coverage_gaps(have: DataFrame, keys: list[str], want: DataFrame) -> DataFrame:
    """Desired counts that the rows fall short of; want has the keys (null: any) and want."""
    marked = have.select(*[F.coalesce(F.col(k), F.lit("\0")).alias(k) for k in keys])  # a null of the data isn't "any"
    counts = marked.rollup(*keys).agg(F.count("*").alias("have"))
    on = [counts[k].eqNullSafe(want[k]) for k in keys]
    joined = want.join(counts, on, "left").select(*[want[k] for k in keys], "want", F.coalesce("have", F.lit(0)).alias("have"))
    return joined.withColumn("deficit", F.col("want") - F.col("have")).where("deficit > 0")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def ab_report(runs: DataFrame) -> DataFrame:
    """Means per arm over the first run of each task."""
    first = first_per_key(runs.where("arm is not null and task_id is not null"), ["arm", "task_id"], [F.col("created_at"), F.col("id"), F.col("ingested_at")])
    q = stats.quality(F.col("user_feedback"), F.col("verifier_score"))
    return first.groupBy("arm").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency"), F.avg(q).alias("quality"), F.avg(F.col("success").cast("double")).alias("success_rate"))


def arm_summary(runs: DataFrame) -> DataFrame:
    """Failures count in n and are left out of the means."""
    good = F.col("success")
    return runs.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(~good).alias("failures"), F.avg(F.when(good, F.col("latency_ms"))).alias("latency"), F.avg(F.when(good, F.col("verifier_score"))).alias("score"))


def pivot_counts(rows: DataFrame, key: str, by: str, values: list) -> DataFrame:
    return rows.groupBy(key).pivot(by, values).count().na.fill(0)


def percentile_nearest(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest rank: the smallest value with at least a share p of the values at or below it."""
    return rows.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p}) within group (order by `{value}`)").alias(name) for name, p in ps.items()])


def percentile_linear(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Linear interpolation between the neighbours; 0.5 is the median."""
    return rows.groupBy(*keys).agg(*[F.percentile(value, p).alias(name) for name, p in ps.items()])


def percentile_index(rows: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """The value at index round(p (n - 1)), halves to even."""
    w = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("__i"), F.count("*").over(w).alias("__n"))
    return ranked.where(F.col("__i") - 1 == F.bround(F.lit(p) * (F.col("__n") - 1), 0)).select(*keys, F.col(value).alias(name))


def histogram(rows: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Cumulative counts of values at or below each edge; the last bucket (null edge) counts all."""
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    index = F.size(F.filter(bounds, lambda e: e < F.col(value)))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, index.alias("i")).agg(F.count("*").alias("c"))
    every = counts.select(*keys).distinct().select(*keys, F.posexplode(F.concat(bounds, F.array(F.lit(None).cast("double")))).alias("i", "le"))
    whole = every.join(counts, [*keys, "i"], "left")
    return whole.select(*keys, "le", "i", F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def histogram_quantile(cumulative: DataFrame, keys: list[str], q: float) -> DataFrame:
    """A quantile interpolated within the bucket where the rank falls; the last finite edge if it falls beyond."""
    w = Window.partitionBy(*keys).orderBy("i")
    rows = cumulative.select("*", F.coalesce(F.lag("cumulative").over(w), F.lit(0)).alias("below"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("from"), F.max("cumulative").over(Window.partitionBy(*keys)).alias("total"))
    hit = rows.where((F.col("cumulative") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    value = F.when(F.col("le").isNull(), F.col("from")).otherwise(F.col("from") + (F.col("le") - F.col("from")) * (q * F.col("total") - F.col("below")) / (F.col("cumulative") - F.col("below")))
    return hit.select(*keys, value.alias("quantile"))


def weekday_hour(rows: DataFrame, ts: str) -> DataFrame:
    """Rows per weekday (Monday 0) and hour, and what a week is to expect: the count over the full weeks seen, at least one."""
    bounds = rows.agg(F.greatest(F.lit(1), F.floor(F.datediff(F.max(ts), F.min(ts)) / 7)).alias("weeks"))
    counts = rows.groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(bounds)).select("weekday", "hour", "n", (F.col("n") / F.col("weeks")).alias("expected"))  # bounds is one row


def slo(runs: DataFrame, key: str, limit_ms: float, availability: float) -> DataFrame:
    """Nearest-rank latencies, availability, and whether both keep their limits."""
    out = runs.groupBy(key).agg(
        *[F.expr(f"percentile_disc({p}) within group (order by latency_ms)").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)],
        F.avg(F.col("success").cast("double")).alias("availability"),
        F.count("*").alias("n"),
    )
    return out.withColumn("met", (F.col("p95") <= limit_ms) & (F.col("availability") >= availability))


def calibration(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """One row: n, expected calibration error (Guo et al. 2017), Brier score and negative log likelihood of binary decisions."""
    p = rows.where(confidence.isNotNull() & correct.isNotNull()).select(confidence.alias("p"), correct.cast("double").alias("y"))
    eps = 1e-12
    clipped = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    by_bin = p.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"), F.sum(-(F.col("y") * F.log(clipped) + (1 - F.col("y")) * F.log(1 - clipped))).alias("nll")
    )
    return by_bin.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum("nll") / F.sum("n")).alias("nll"))


def risk_coverage(rows: DataFrame, confidence: Column, correct: Column, steps: int = 20) -> DataFrame:
    """Share of accepted rows and their accuracy for thresholds 0, 1/steps, ... 1; null accuracy where nothing is accepted.

    Rows are counted by the highest threshold they pass, so they aren't multiplied by the thresholds."""
    base = rows.where(confidence.isNotNull() & correct.isNotNull()).select(F.least(F.floor(confidence * steps + 1e-9), F.lit(steps)).cast("int").alias("step"), correct.cast("int").alias("y"))
    counts = base.groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    every = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    w = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # steps + 1 rows
    run = every.join(counts, "step", "left").select("step", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("accepted"), F.sum(F.coalesce("good", F.lit(0))).over(w).alias("good"), F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy()).alias("total"))
    return run.select((F.col("step") / steps).alias("threshold"), (F.col("accepted") / F.col("total")).alias("coverage"), F.when(F.col("accepted") > 0, F.col("good") / F.col("accepted")).alias("accuracy"))


def select_threshold(curve: DataFrame, least_coverage: float = 0.5, least_accuracy: float = 0.95) -> DataFrame:
    """The lowest threshold that keeps coverage and accuracy; 1.01 if none does."""
    return curve.where((F.col("coverage") >= least_coverage) & (F.col("accuracy") >= least_accuracy)).agg(F.coalesce(F.min("threshold"), F.lit(1.01)).alias("threshold"))


def weighted_mean_vectors(rows: DataFrame, key: str, weight: str, vector: str) -> DataFrame:
    """Element-wise mean weighted by examples (McMahan et al. 2017), and element-wise median."""
    parts = rows.select(key, F.col(weight).alias("w"), F.posexplode(vector).alias("pos", "x"))
    return parts.groupBy(key, "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"), F.percentile("x", 0.5).alias("median"))


def clip_l2(rows: DataFrame, vector: str, limit: float) -> DataFrame:
    """Vectors scaled down to a norm of limit where it is larger."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scale = F.when(norm > limit, limit / norm).otherwise(1.0)
    return rows.withColumn("norm", norm).withColumn(vector, F.transform(vector, lambda x: x.cast("double") * scale))


def k_anonymous(rows: DataFrame, keys: list[str], subject: str, k: int) -> DataFrame:
    """Distinct subjects per key; a count under k is suppressed (null)."""
    counts = rows.groupBy(*keys).agg(F.countDistinct(subject).alias("c"))
    return counts.select(*keys, F.when(F.col("c") >= k, F.col("c")).alias("subjects"), (F.col("c") < k).alias("suppressed"))


def share_of_total(rows: DataFrame, key: str, value: str, least_share: float, least_n: int) -> DataFrame:
    """Keys that take a large share of the whole and have enough rows."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return sums.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy())).where((F.col("share") >= least_share) & (F.col("n") >= least_n))


def top_two_gap(rows: DataFrame, group: str, member: str, value: str, least_gap: float, least_n: int) -> DataFrame:
    """Groups whose best member leads the second by a gap, both with enough rows."""
    means = rows.where(F.col(value).isNotNull()).groupBy(group, member).agg(F.avg(value).alias("m"), F.count("*").alias("n")).where(F.col("n") >= least_n)
    ranked = means.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("m"), member)))
    two = ranked.groupBy(group).agg(F.max(F.when(F.col("r") == 1, F.col("m"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("m"))).alias("second"), F.max(F.when(F.col("r") == 1, F.col(member))).alias(member))
    return two.where(F.col("best") - F.col("second") >= least_gap)


def information_gain(rows: DataFrame, outcome: str, label: str) -> DataFrame:
    """Entropy of the label less what is left of it once the outcome is known (nats)."""
    cells = rows.groupBy(outcome, label).agg(F.count("*").alias("n"))
    total, by_outcome, by_label = F.sum("n").over(Window.partitionBy()), F.sum("n").over(Window.partitionBy(outcome)), F.sum("n").over(Window.partitionBy(label))
    parts = cells.select("n", total.alias("t"), by_outcome.alias("o"), by_label.alias("l"))
    return parts.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("o") * F.col("l")))).alias("gain"))


def word_counts(texts: DataFrame, text: str, least: int) -> DataFrame:
    words = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
