"""Versions, chains, stages and other ordered analytics, and joins with plans of their own."""

from pyspark.sql import functions as F

from quern.functions import stats
from quern.functions.hashing import hash_bucket
from quern.operators import joins, windows
from quern.operators.orphans import norm_key
from quern.sources.tables import table


def _r(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def _tasks(s, d):
    return table(s, d, "tasks").where(norm_key(F.col("id")).isNotNull()).withColumn("key", norm_key(F.col("id")))


def _order():
    return [F.col("ingested_at"), F.coalesce("status", F.lit("")), F.coalesce("final_response", F.lit("")), F.coalesce("request", F.lit(""))]


def w1_latest(s, d):
    return windows.latest_version(_tasks(s, d), F.col("key"), _order()).select("key", "status", "ingested_at", "deleted_at")


def w2_as_of(s, d):
    return windows.as_of(_tasks(s, d), F.col("key"), F.col("ingested_at"), F.lit("2025-03-01").cast("timestamp_ntz"), _order()).groupBy("status").agg(F.count("*").alias("n"))


def w3_chain(s, d):
    e = table(s, d, "orders")
    entries = windows.chain(e, "o_orderstatus", [F.col("o_orderkey")], F.col("o_orderpriority"))
    spoilt = entries.withColumn("body", F.when((F.col("o_orderstatus") == "P") & (F.col("seq") == 3), "tampered").otherwise(F.col("body")))
    return windows.verify_chain(spoilt, "o_orderstatus").withColumn("broken_seq", F.col("broken_seq").cast("string"))


def _ev(s, d):
    return table(s, d, "events")


def k1_topk(s, d):
    from quern.operators.topk import cosine_topk

    e = table(s, d, "embeddings")
    return _r(cosine_topk(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5), "similarity", digits=4)


def w8(s, d):
    return windows.succession(_ev(s, d).where("event_type is not null"), ["user_id"], "ts", "event_type", [F.col("ts"), F.col("event_id")])


def j8_valid_at(s, d):
    return joins.valid_at(w8(s, d), F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "event_type", "valid_from")


def j16_pairs(s, d):
    e = _ev(s, d)
    return _r(joins.pair_kth(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", ["event_id"]).groupBy("user_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("ended") >= F.col("started")).alias("forward")))


def j_asof(s, d):
    e = _ev(s, d)
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("click_value"))
    return joins.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "ts", ["click_value"])


def j_interval(s, d):
    e = _ev(s, d)
    facts = w8(s, d).withColumnRenamed("event_type", "state")
    return joins.interval_join(e.select("event_id", "user_id", "ts"), facts, "user_id", "ts").groupBy("state").agg(F.count("*").alias("n"))


def j11_compare(s, d):
    runs = table(s, d, "inference_runs").where("success is not null and task_id is not null")
    half = hash_bucket(F.col("id"), 2)
    a = runs.where(half == 0).groupBy("task_id").agg(F.min("success").alias("ok"))
    b = runs.where(half == 1).groupBy("task_id").agg(F.min("success").alias("ok"))
    return joins.compare_reports(a, b, "task_id", "ok").groupBy("change").agg(F.count("*").alias("n"))


def j13_agreement(s, d):
    return _r(joins.pairwise_agreement(table(s, d, "inference_runs").where("task_type is not null").select("task_type", "id", F.round("verifier_score", 1).alias("v")), "task_type", "id", "v"), "agreement")


def w7_ema(s, d):
    r = table(s, d, "inference_runs").where("model_id is not null and verifier_score is not null").withColumn("o", F.struct("created_at", "id", "ingested_at"))
    return _r(windows.ema(r, ["model_id"], F.col("o"), "verifier_score", 0.05, 0.5), "ema")


def t34_budget(s, d):
    docs = table(s, d, "documents").where("n_chars > 0")
    return windows.running_budget(docs.select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], F.ceil(F.col("n_chars") / 4), 3000)


def w9_beliefs(s, d):
    c = table(s, d, "inference_runs").where("task_type is not null and model_id is not null and verifier_score is not null").groupBy("task_type", "model_id").agg(F.round(F.avg("verifier_score"), 6).alias("confidence"))
    return windows.rank_beliefs(c, ["task_type"], "model_id", "confidence", clear=0.03, near=0.05, sure=0.7)


QUERIES = {
    "w1_latest_version": w1_latest,
    "w2_as_of": w2_as_of,
    "w3_chain_check": w3_chain,
    "w4_stage_durations": lambda s, d: _r(windows.stage_durations(_ev(s, d), "user_id", "ts", "event_type", [F.col("ts"), F.col("event_id")]).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_s")), "mean_s", digits=4),
    "w6_last_n": lambda s, d: windows.last_n(_ev(s, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id"),
    "w7_ema": w7_ema,
    "w8_succession": lambda s, d: w8(s, d),
    "w9_belief_ranking": w9_beliefs,
    "w10_sequence_pairs": lambda s, d: windows.sequence_pairs(_ev(s, d), "user_id", "event_type", [F.col("ts"), F.col("event_id")], 50),
    "w11_rolling_rate": lambda s, d: windows.rolling_rate(_ev(s, d), "user_id", "ts", 86400).select("event_id", "in_window"),
    "k1_topk_cosine": k1_topk,
    "k10_range_sorted": lambda s, d: _ev(s, d).where(F.col("ts").between(F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-04").cast("timestamp_ntz"))).orderBy("ts", "event_id").select("event_id", "ts"),
    "j8_valid_at": j8_valid_at,
    "j11_compare_reports": j11_compare,
    "j13_pairwise_agreement": j13_agreement,
    "j14_pareto": lambda s, d: joins.pareto(table(s, d, "supplier"), "s_suppkey", ["s_nationkey", "s_acctbal"]).select("s_suppkey"),
    "j16_start_end_pairs": j16_pairs,
    "j_as_of": j_asof,
    "j_interval": j_interval,
    "t34_budget_packing": t34_budget,
    "t40_decay": lambda s, d: _ev(s, d).where("value > 0").select("event_id", F.round(stats.decay(F.lit(1.0), F.lit(0.01), F.col("value")), 6).alias("left")),
}

_KEY = r"nullif(nullif(regexp_replace(regexp_replace(translate(lower(id), '{}-', ''), '^\s+|\s+$', '', 'g'), '^urn:uuid:', ''), ''), repeat('0', 32))"
_ORD = "ingested_at, coalesce(status, ''), coalesce(final_response, ''), coalesce(request, '')"
_STATE = "changed as (select * from (select user_id, event_type, ts, event_id, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is null or before <> event_type), fact as (select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts, event_id) as valid_until from changed)"
SQL = {
    "w1_latest_version": f"select key, status, ingested_at, deleted_at from (select *, {_KEY} as key, row_number() over (partition by {_KEY} order by ingested_at desc, coalesce(status, '') desc, coalesce(final_response, '') desc, coalesce(request, '') desc) as rn from tasks) where rn = 1 and key is not null",
    "w2_as_of": f"select status, count(*) as n from (select *, {_KEY} as key, row_number() over (partition by {_KEY} order by ingested_at desc, coalesce(status, '') desc, coalesce(final_response, '') desc, coalesce(request, '') desc) as rn from tasks where ingested_at <= timestamp '2025-03-01') where rn = 1 and key is not null group by status",
    "w3_chain_check": "select o_orderstatus, count(*) as entries, case when o_orderstatus = 'P' then '3' end as broken_seq, case when o_orderstatus = 'P' then 'body' end as broken_why from orders group by 1",
    "w4_stage_durations": "select event_type, count(*) as n, round(avg(epoch_us(ended) - epoch_us(ts)) / 1e6, 4) as mean_s from (select event_type, ts, lead(ts) over (partition by user_id order by ts, event_id) as ended from events) where ended is not null group by 1",
    "w6_last_n": "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 5",
    "w7_ema": "with r as (select model_id, verifier_score as x, row_number() over (partition by model_id order by created_at desc, id desc, ingested_at desc) - 1 as age from inference_runs where model_id is not null and verifier_score is not null) select model_id, round(sum(0.05 * pow(0.95, age) * x) + pow(0.95, count(*)) * 0.5, 6) as ema, count(*) as n from r group by 1",
    "w8_succession": f"with {_STATE} select user_id, event_type, valid_from, valid_until from fact",
    "w9_belief_ranking": "with c as (select task_type, model_id, round(avg(verifier_score), 6) as confidence from inference_runs where task_type is not null and model_id is not null and verifier_score is not null group by all), b as (select *, max(confidence) over (partition by task_type) as best, row_number() over (partition by task_type order by confidence desc, model_id) as r from c) select task_type, model_id, confidence, case when r = 1 then 'current' when best >= 0.7 and best - confidence >= 0.03 then 'obsolete' when best - confidence < 0.05 then 'contested' else 'open' end as status from b",
    "w10_sequence_pairs": "select cause, effect, count(*) as n from (select lag(event_type) over (partition by user_id order by ts, event_id) as cause, event_type as effect from events) where cause is not null group by all having count(*) >= 50",
    "w11_rolling_rate": "select event_id, count(*) over (partition by user_id order by ts range between interval 86400 seconds preceding and current row) as in_window from events",
    "k1_topk_cosine": "with q as (select vec_id as q, embedding as e from embeddings where vec_id % 50 = 0), s as (select q, vec_id, list_cosine_similarity(q.e::double[], d.embedding::double[]) as sim from q, embeddings d where q <> vec_id), r as (select *, row_number() over (partition by q order by sim desc, vec_id) as rank from s) select q as query_id, vec_id, round(sim, 4) as similarity, rank::int as rank from r where rank <= 5",
    "k10_range_sorted": "select event_id, ts from events where ts between timestamp '2024-01-03' and timestamp '2024-01-04'",
    "j8_valid_at": f"with {_STATE} select user_id, event_type, valid_from from fact where valid_from <= timestamp '2024-01-15' and (valid_until is null or timestamp '2024-01-15' < valid_until)",
    "j11_compare_reports": "with r as (select task_id, success, ('0x' || substr(sha256(id), 1, 8))::ubigint % 2 as half from inference_runs where success is not null and task_id is not null), b as (select task_id, min(success) as was from r where half = 0 group by 1), a as (select task_id, min(success) as isnow from r where half = 1 group by 1), j as (select case when isnow is null then 'missing' when was is null then 'new' when was and not isnow then 'regression' when not was and isnow then 'improvement' end as change from b full join a using (task_id)) select change, count(*) as n from j where change is not null group by 1",
    "j13_pairwise_agreement": "with c as (select task_type, round(verifier_score, 1) as v, count(*) as c from inference_runs where task_type is not null and verifier_score is not null group by all) select task_type, sum(c)::bigint as n, round(sum(c * (c - 1) / 2) / (sum(c) * (sum(c) - 1) / 2), 6) as agreement from c group by 1 having sum(c) >= 2",
    "j14_pareto": "select s_suppkey from supplier a where not exists (select 1 from supplier b where b.s_nationkey >= a.s_nationkey and b.s_acctbal >= a.s_acctbal and (b.s_nationkey > a.s_nationkey or b.s_acctbal > a.s_acctbal))",
    "j16_start_end_pairs": "with s as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'click'), e as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'purchase') select user_id, count(*) as pairs, count(*) filter (where e.ts >= s.ts) as forward from s join e using (user_id, k) group by 1",
    "j_as_of": "with c as (select user_id, ts, max(value) as click_value from events where event_type = 'click' group by all) select p.event_id, p.user_id, p.ts, c.click_value from (select * from events where event_type = 'purchase') p asof left join c on p.user_id = c.user_id and p.ts >= c.ts",
    "j_interval": f"with {_STATE} select f.event_type as state, count(*) as n from events e join fact f on e.user_id = f.user_id and f.valid_from <= e.ts and (f.valid_until is null or e.ts < f.valid_until) group by 1",
    "t34_budget_packing": "select source, doc_id, n_chars, used::bigint as used from (select source, doc_id, n_chars, sum(ceil(n_chars / 4)::bigint) over (partition by source order by doc_id rows unbounded preceding) as used from documents where n_chars > 0) where used <= 3000",
    "t40_decay": "select event_id, round(exp(-0.01 * value), 6) as left from events where value > 0",
}
