"""Aggregations over runs, events and traces."""

from pyspark.sql import functions as F

from quern.functions import stats
from quern.operators import aggregates as agg
from quern.sources.tables import table


def _runs(spark, d):
    return table(spark, d, "inference_runs")


def _r(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def _want(spark):
    return spark.createDataFrame([("es", None, 400), ("en", None, 100), ("es", "Trace digests", 50), ("de", "Tool manuals", 5)], "lang string, source string, want bigint")


def a16_wilson(s, d):
    c = _runs(s, d).where("success is not null").groupBy("model_id").agg(F.count_if("success").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return _r(c.select("model_id", "k", "n", low.alias("low"), high.alias("high")), "low", "high")


def _calibrated(s, d):
    return _runs(s, d).where("task_confidence is not null and success is not null")


def a32_smoothed(s, d):
    c = _runs(s, d).where("success is not null").groupBy("role", "mode").agg(F.count_if("success").alias("k"), F.count("*").alias("n")).where("n >= 3")
    return _r(c.select("role", "mode", stats.smoothed_rate(F.col("k"), F.col("n")).alias("rate")), "rate")


def a22_noisy_or(s, d):
    e = _runs(s, d).where("verifier_score is not null").groupBy("task_type", "model_id").agg(F.max("verifier_score").alias("s"))
    return _r(e.groupBy("task_type").agg(stats.noisy_or_of(F.col("s")).alias("belief")), "belief")


def a20_eval_summary(s, d):
    suite = _runs(s, d).where("verifier_score is not null").groupBy("task_type").agg(F.avg("verifier_score").alias("mean"), F.count_if(F.col("verifier_score") >= 0.8).alias("passed"), F.count("*").alias("total"))
    overall = suite.agg(F.lit("overall").alias("task_type"), F.avg("mean").alias("mean"), F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    return _r(suite.unionByName(overall), "mean")


def h5_softmax(s, d):
    scores = _runs(s, d).where("verifier_score is not null and model_id is not null").groupBy("task_type", "model_id").agg(F.avg("verifier_score").alias("m"))
    by = scores.groupBy("task_type").agg(F.sort_array(F.collect_list(F.struct("model_id", "m"))).alias("x"))
    out = by.select("task_type", F.explode(F.arrays_zip(F.col("x.model_id").alias("model_id"), stats.softmax(F.col("x.m"), 0.1).alias("p"))).alias("z"))
    return _r(out.select("task_type", "z.model_id", "z.p"), "p")


def a7_status_pivot(s, d):
    return agg.pivot_counts(table(s, d, "tasks"), "route", "status", ["completed", "running", "created", "failed", "deleted"]).withColumnRenamed("completed", "done")


def a26_lexicon(s, d):
    return agg.word_counts(table(s, d, "documents"), "text", 20)


def a27_fedavg(s, d):
    e = table(s, d, "embeddings").select("label", (F.col("vec_id") % 7 + 1).alias("n"), F.col("embedding").cast("array<double>").alias("v"))
    return _r(agg.weighted_mean_vectors(e, "label", "n", "v"), "mean", "median", digits=5)


def a28_clip(s, d):
    e = agg.clip_l2(table(s, d, "embeddings"), "embedding", 0.9)
    return e.select("vec_id", F.round("norm", 5).alias("norm"), F.round(F.col("embedding")[0], 5).alias("first"))


def a11_histogram(s, d):
    return agg.histogram(_runs(s, d), ["task_type"], "latency_ms", [50, 100, 250, 500, 1000, 2500])


QUERIES = {
    "a1_model_stats": lambda s, d: _r(agg.model_stats(_runs(s, d)), "success_rate", "latency", "quality"),
    "a3_grouping_sets": lambda s, d: _r(agg.multi_granularity(_runs(s, d)), "sum_q", "sum_ms", digits=4),
    "a4_coverage_gaps": lambda s, d: agg.coverage_gaps(table(s, d, "documents").select("lang", "source"), ["lang", "source"], _want(s)),
    "a5_ab_report": lambda s, d: _r(agg.ab_report(_runs(s, d).where("id is not null")), "latency", "quality", "success_rate"),
    "a6_arm_summary": lambda s, d: _r(agg.arm_summary(_runs(s, d)), "latency", "score"),
    "a7_status_pivot": a7_status_pivot,
    "a8_event_metrics": lambda s, d: table(s, d, "task_events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("tasks"), F.round(F.avg(F.get_json_object("payload", "$.ms").cast("double")), 4).alias("mean_ms")),
    "a10_percentile_nearest": lambda s, d: agg.percentile_nearest(_runs(s, d), ["task_type"], "latency_ms", {"p50": 0.5, "p95": 0.95}),
    "a10_percentile_linear": lambda s, d: _r(agg.percentile_linear(_runs(s, d), ["task_type"], "latency_ms", {"p50": 0.5, "p90": 0.9}), "p50", "p90"),
    "a10_percentile_index": lambda s, d: agg.percentile_index(_runs(s, d), ["task_type"], "latency_ms", 0.95, "p95"),
    "a11_histogram": a11_histogram,
    "a12_histogram_quantile": lambda s, d: _r(agg.histogram_quantile(a11_histogram(s, d), ["task_type"], 0.9), "quantile"),
    "a13_stage_profile": lambda s, d: _runs(s, d).groupBy(F.substring_index("model_id", "-", 2).alias("stage")).agg(F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.sum(F.col("input_tokens").cast("bigint")).alias("tokens")),
    "a14_weekday_hour": lambda s, d: _r(agg.weekday_hour(table(s, d, "events"), "ts"), "expected"),
    "a15_slo": lambda s, d: _r(agg.slo(_runs(s, d), "task_type", 2500.0, 0.8), "availability"),
    "a16_wilson": a16_wilson,
    "a17_calibration": lambda s, d: _r(agg.calibration(_calibrated(s, d), F.col("task_confidence"), F.col("success")), "ece", "brier", "nll"),
    "a18_threshold": lambda s, d: agg.select_threshold(agg.risk_coverage(_calibrated(s, d), F.col("task_confidence"), F.col("success")), 0.3, 0.8),
    "a20_eval_summary": a20_eval_summary,
    "a22_noisy_or": a22_noisy_or,
    "a26_lexicon": a26_lexicon,
    "a27_fedavg": a27_fedavg,
    "a28_clip": a28_clip,
    "a29_k_anonymous": lambda s, d: agg.k_anonymous(table(s, d, "events").withColumn("day", F.date_trunc("day", "ts")), ["event_type", "day"], "user_id", 40),
    "a31_failures": lambda s, d: _runs(s, d).groupBy("model_id", "task_type").agg(F.count_if(~F.col("success")).alias("failures"), F.count("*").alias("runs")).where("failures > 0"),
    "a32_smoothed": a32_smoothed,
    "a38_compute_share": lambda s, d: _r(agg.share_of_total(_runs(s, d).where("latency_ms is not null"), "task_type", "latency_ms", 0.15, 20), "total", "share", digits=4),
    "a42_top_two_gap": lambda s, d: _r(agg.top_two_gap(_runs(s, d), "task_type", "model_id", "verifier_score", 0.001, 5), "best", "second"),
    "a43_information_gain": lambda s, d: _r(agg.information_gain(_runs(s, d).where("success is not null and model_id is not null"), "model_id", "success"), "gain", digits=7),
    "a47_risk_coverage": lambda s, d: _r(agg.risk_coverage(_calibrated(s, d), F.col("task_confidence"), F.col("success")), "threshold", "coverage", "accuracy"),
    "h5_softmax": h5_softmax,
}

_Q = "coalesce(user_feedback, verifier_score)"
_BUCKET = "case when coalesce(complexity, 0) < 0.3 then 'low' when coalesce(complexity, 0) < 0.6 then 'medium' when coalesce(complexity, 0) < 0.8 then 'high' else 'extreme' end"
_HIST = """
with v as (select task_type, latency_ms as x from inference_runs where latency_ms is not null),
e as (select unnest([50.0, 100, 250, 500, 1000, 2500, null]::double[]) as le, unnest(range(7))::int as i),
h as (select t.task_type, e.le, e.i, (select count(*) from v where v.task_type is not distinct from t.task_type and (e.le is null or v.x <= e.le)) as cumulative
      from (select distinct task_type from v) t, e)
"""
_CURVE = """
with c as (select task_confidence as p, success::int as y from inference_runs where task_confidence is not null and success is not null),
t as (select unnest(range(21)) as k),
curve as (select k / 20.0 as threshold, count(*) filter (where least(floor(p * 20 + 1e-9), 20) >= k) / count(*)::double as coverage,
          sum(y) filter (where least(floor(p * 20 + 1e-9), 20) >= k) / nullif(count(*) filter (where least(floor(p * 20 + 1e-9), 20) >= k), 0)::double as accuracy from t, c group by k)
"""
SQL = {
    "a1_model_stats": f"select model_id, task_type, count(*) as runs, round(avg(success::int), 6) as success_rate, round(avg(latency_ms), 6) as latency, round(avg({_Q}), 6) as quality from inference_runs group by all",
    "a3_grouping_sets": f"select task_type, bucket, mode, model_id, count(*) as n, round(sum(q), 4) as sum_q, round(sum(latency_ms), 4) as sum_ms from (select task_type, {_BUCKET} as bucket, coalesce(mode, 'none') as mode, model_id, {_Q} as q, latency_ms from inference_runs) where q is not null group by grouping sets ((task_type, bucket, mode, model_id), (task_type, model_id))",
    "a4_coverage_gaps": """
with want(lang, source, want) as (values ('es', null, 400), ('en', null, 100), ('es', 'Trace digests', 50), ('de', 'Tool manuals', 5)),
c as (select w.lang, w.source, w.want::bigint as want, (select count(*) from documents d where d.lang = w.lang and (w.source is null or d.source = w.source)) as n from want w)
select lang, source, want, n as have, want - n as deficit from c where want > n""",
    "a5_ab_report": f"select arm, count(*) as n, round(avg(latency_ms), 6) as latency, round(avg({_Q}), 6) as quality, round(avg(success::int), 6) as success_rate from (select *, row_number() over (partition by arm, task_id order by created_at, id, ingested_at) as rn from inference_runs where arm is not null and task_id is not null and id is not null) where rn = 1 group by arm",
    "a6_arm_summary": "select arm, count(*) as n, count(*) filter (where not success) as failures, round(avg(latency_ms) filter (where success), 6) as latency, round(avg(verifier_score) filter (where success), 6) as score from inference_runs group by arm",
    "a7_status_pivot": "select route, count(*) filter (where status = 'completed') as done, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'created') as created, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'deleted') as deleted from tasks group by route",
    "a8_event_metrics": "select event_type, count(*) as n, count(distinct task_id) as tasks, round(avg(try_cast(json_extract_string(payload, '$.ms') as double)), 4) as mean_ms from task_events group by event_type",
    "a10_percentile_nearest": "select task_type, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95 from inference_runs group by task_type",
    "a10_percentile_linear": "select task_type, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.9), 6) as p90 from inference_runs group by task_type",
    "a10_percentile_index": "select task_type, latency_ms as p95 from (select task_type, latency_ms, row_number() over (partition by task_type order by latency_ms) - 1 as i, count(*) over (partition by task_type) as n from inference_runs where latency_ms is not null) where i = round_even(0.95 * (n - 1), 0)",
    "a11_histogram": _HIST + "select task_type, le, i, cumulative from h",
    "a12_histogram_quantile": _HIST + """, b as (select *, coalesce(lag(cumulative) over w, 0) as below, coalesce(lag(le) over w, 0) as lo, max(cumulative) over (partition by task_type) as total from h window w as (partition by task_type order by i))
select task_type, round(case when le is null then lo else lo + (le - lo) * (0.9 * total - below) / (cumulative - below) end, 6) as quantile from b where cumulative >= 0.9 * total and below < 0.9 * total""",
    "a13_stage_profile": "select array_to_string(string_split(model_id, '-')[1:2], '-') as stage, round(avg(latency_ms), 4) as mean_ms, sum(input_tokens)::bigint as tokens from inference_runs group by 1",
    "a14_weekday_hour": "with w as (select greatest(1, floor(date_diff('day', min(ts)::date, max(ts)::date) / 7)) as weeks from events) select (isodow(ts) - 1)::int as weekday, hour(ts)::int as hour, count(*) as n, round(count(*) / any_value(weeks), 6) as expected from events, w group by 1, 2",
    "a15_slo": "select task_type, p50, p95, p99, round(a, 6) as availability, n, p95 <= 2500 and a >= 0.8 as met from (select task_type, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95, quantile_disc(latency_ms, 0.99) as p99, avg(success::int) as a, count(*) as n from inference_runs group by task_type)",
    "a16_wilson": "select model_id, k, n, round(greatest((k/n + 3.8416/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4.0*n*n))) / (1 + 3.8416/n), 0), 6) as low, round(least((k/n + 3.8416/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4.0*n*n))) / (1 + 3.8416/n), 1), 6) as high from (select model_id, count(*) filter (where success) as k, count(*) as n from inference_runs where success is not null group by model_id)",
    "a17_calibration": """
with c as (select task_confidence as p, success::int::double as y, least(greatest(task_confidence, 1e-12), 1 - 1e-12) as q from inference_runs where task_confidence is not null and success is not null),
b as (select least(floor(p * 10), 9) as bin, count(*) as n, avg(p) as mp, avg(y) as my, sum((p - y) ** 2) as sq, sum(-(y * ln(q) + (1 - y) * ln(1 - q))) as nll from c group by 1)
select sum(n)::bigint as n, round(sum(n * abs(mp - my)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier, round(sum(nll) / sum(n), 6) as nll from b""",
    "a18_threshold": _CURVE + "select coalesce(min(threshold), 1.01)::double as threshold from curve where coverage >= 0.3 and accuracy >= 0.8",
    "a20_eval_summary": "with s as (select task_type, avg(verifier_score) as mean, count(*) filter (where verifier_score >= 0.8) as passed, count(*) as total from inference_runs where verifier_score is not null group by 1) select task_type, round(mean, 6) as mean, passed, total from s union all select 'overall', round(avg(mean), 6), sum(passed)::bigint, sum(total)::bigint from s",
    "a22_noisy_or": "with e as (select task_type, model_id, max(verifier_score) as s from inference_runs where verifier_score is not null group by all) select task_type, round(1 - product(1 - least(s, 0.999)), 6) as belief from e group by task_type",
    "a26_lexicon": r"select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as word from documents) where word <> '' group by word having count(*) >= 20",
    "a27_fedavg": "with p as (select label, vec_id % 7 + 1 as n, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) select label, pos::int as pos, round(sum(x * n) / sum(n), 5) as mean, round(median(x), 5) as median from p group by 1, 2",
    "a28_clip": "select vec_id, round(norm, 5) as norm, round(x * case when norm > 0.9 then 0.9 / norm else 1 end, 5) as first from (select vec_id, sqrt(list_sum(list_transform(embedding::double[], lambda v: v * v))) as norm, embedding[1]::double as x from embeddings)",
    "a29_k_anonymous": "select event_type, day, case when c >= 40 then c end as subjects, c < 40 as suppressed from (select event_type, date_trunc('day', ts)::timestamp as day, count(distinct user_id) as c from events group by all)",
    "a31_failures": "select model_id, task_type, count(*) filter (where not success) as failures, count(*) as runs from inference_runs group by all having failures > 0",
    "a32_smoothed": "select role, mode, round((k + 1) / (n + 2), 6) as rate from (select role, mode, count(*) filter (where success) as k, count(*) as n from inference_runs where success is not null group by all) where n >= 3",
    "a38_compute_share": "select task_type, round(total, 4) as total, n, round(share, 4) as share from (select task_type, sum(latency_ms) as total, count(*) as n, sum(latency_ms) / sum(sum(latency_ms)) over () as share from inference_runs where latency_ms is not null group by 1) where share >= 0.15 and n >= 20",
    "a42_top_two_gap": "with m as (select task_type, model_id, avg(verifier_score) as m from inference_runs where verifier_score is not null group by all having count(*) >= 5), r as (select *, row_number() over (partition by task_type order by m desc, model_id nulls first) as r from m), t as (select task_type, max(m) filter (where r = 1) as best, max(m) filter (where r = 2) as second, max(model_id) filter (where r = 1) as model_id from r group by 1) select task_type, round(best, 6) as best, round(second, 6) as second, model_id from t where best - second >= 0.001",
    "a43_information_gain": "with c as (select model_id, success, count(*)::double as n from inference_runs where success is not null and model_id is not null group by all), p as (select n, sum(n) over () as t, sum(n) over (partition by model_id) as o, sum(n) over (partition by success) as l from c) select round(sum(n / t * ln(n * t / (o * l))), 7) as gain from p",
    "a47_risk_coverage": _CURVE + "select round(threshold, 6)::double as threshold, round(coverage, 6) as coverage, round(accuracy, 6) as accuracy from curve",
    "h5_softmax": "with m as (select task_type, model_id, avg(verifier_score) as m from inference_runs where verifier_score is not null and model_id is not null group by all) select task_type, model_id, round(exp((m - max(m) over w) / 0.1) / sum(exp((m - mx) / 0.1)) over w, 6) as p from (select *, max(m) over (partition by task_type) as mx from m) window w as (partition by task_type)",
}
