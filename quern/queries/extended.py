"""Document forms, rankings, gates, folds and projections."""

from pyspark.sql import functions as F

from quern.functions import documents as df_
from quern.functions import text as tx
from quern.functions.hashing import simhash_of_text
from quern.operators import decisions as dec
from quern.operators import joins, records
from quern.operators.topk import cosine, rerank, similar
from quern.session import spill, spread
from quern.sources import files
from quern.sources.tables import table

STOP = {"en": ["the", "of", "and", "to", "in", "with"], "es": ["el", "la", "de", "los", "las", "con"], "de": ["der", "die", "das", "und", "des", "mit"], "fr": ["le", "les", "des", "du", "et", "pour"]}


def _docs(s, d):
    return table(s, d, "documents").where("text is not null")


def _runs(s, d):
    return table(s, d, "inference_runs")


def _r(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def t9_language_evidence(s, d):
    x = _docs(s, d).select("doc_id", df_.stopword_share(tx.words(F.lower("text")), STOP).alias("m"), F.size(tx.words(F.col("text"))).alias("n"))
    return x.select("doc_id", F.when((F.col("m.hits") >= 2) & (F.col("m.hits") >= 0.08 * F.col("n")), F.col("m.language")).alias("language"))


def t10_oov(s, d):
    words = _docs(s, d).select("doc_id", F.explode(tx.word_tokens(F.col("text"))).alias("w")).where(F.col("w").rlike(r"^\p{L}{2,}$"))
    counted = words.groupBy("doc_id", "w").agg(F.count("*").alias("n"))  # a hot word is one row a document
    rare = counted.groupBy("w").agg(F.count("*").alias("docs")).where("docs < 3").select("w", F.lit(1).alias("rare"))  # what is joined has no hot word
    return counted.join(rare, "w", "left").groupBy("doc_id").agg(F.round(F.sum(F.when(F.col("rare") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("oov"))


def t16_code(s, d):
    f = table(s, d, "source_files").where("path like '%.py' and text is not null")
    return f.select("file_id", F.coalesce(df_.code_reason_udf("text"), F.lit("ok")).alias("reason"), df_.structure_hash_udf("text").alias("shape"))


def s13_code_graph(s, d):
    f = table(s, d, "source_files").where("path like '%.py' and text is not null")
    return f.select("file_id", F.explode(df_.code_edges_udf("text")).alias("e")).select("file_id", "e.kind", "e.source", "e.target")


def j17_call_resolution(s, d):
    e = s13_code_graph(s, d)
    first = e.where("kind = 'defines'").groupBy("target").agg(F.min("file_id").alias("defined_in"))
    return e.where("kind = 'calls'").join(first, "target").groupBy("target", "defined_in").agg(F.count("*").alias("calls"))


def t27_embed(s, d):
    a = _docs(s, d).where("length(text) > 0").select("doc_id", df_.embed_udf("text").alias("v"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("v").alias("w"))
    return a.join(b, "doc_id").select("doc_id", F.round(cosine(F.col("v"), F.col("w")), 4).alias("similarity"))


def t30_containment(s, d):
    t = table(s, d, "cognitive_traces").select("trace_id", tx.word_tokens(F.col("final_answer")).alias("a"), tx.word_tokens(F.col("input")).alias("b")).dropDuplicates(["trace_id"])
    return t.select("trace_id", F.round(df_.containment(F.col("a"), F.col("b"), STOP["en"] + STOP["es"]), 6).alias("share"))


def t30_claims(s, d):
    t = table(s, d, "cognitive_traces").where("length(final_answer) > 0").dropDuplicates(["trace_id"])
    return t.select("trace_id", F.posexplode(df_.claims_udf("final_answer")).alias("pos", "claim"))


def t36_slug(s, d):
    return table(s, d, "nation").select("n_nationkey", df_.slug(F.col("n_name")).alias("slug"))


def t37_contains(s, d):
    return _docs(s, d).select("doc_id", F.round(df_.contains_all(F.col("text"), ["registro", "index", "plazo"]), 6).alias("score"))


def t38_json(s, d):
    e = table(s, d, "task_events").where("payload is not null").select("event_type", "payload")
    p = e.groupBy("event_type").agg(F.min("payload").alias("a"), F.max("payload").alias("b"))
    return p.select("event_type", df_.same_json_udf("a", "a").alias("self"), df_.same_json_udf("a", "b").alias("other"))


def h12_lcs(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: F.substring(x["event_type"], 1, 1)), "").alias("p"))
    n = e.select((F.col("user_id") - 1).alias("user_id"), F.col("p").alias("q"))
    return e.join(n, "user_id").select("user_id", df_.lcs_udf("p", "q").alias("lcs"))


def h10_critical(s, d):
    o = table(s, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("plan"), F.col("l_linenumber").cast("bigint").alias("node"), F.col("l_quantity").cast("double").alias("cost"))
    return dec.critical_paths(o.select("plan", "node", "cost", F.array(F.floor(F.col("node") / 2).cast("bigint")).alias("depends")))


def k2_rerank(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0")
    near = similar(q, e, "vec_id", "embedding", 0.15)
    c = near.join(e.select("vec_id", (F.col("label") / 10.0).alias("confidence"), (F.col("vec_id") % 90).alias("days")), "vec_id").select("vec_id", "query_id", "similarity", "confidence", "days")
    return _r(rerank(c, {"similarity": 0.55, "confidence": 0.15}, F.col("days"), 0.15, 10, "query_id").select("query_id", "vec_id", "score"), "score", digits=5)


def k4_odds(s, d):
    c = _runs(s, d).where("verifier_score is not null and model_id is not null").groupBy("task_type", "model_id").agg(F.round(F.avg("verifier_score"), 6).alias("score"))
    return _r(dec.candidate_odds(c, "task_type", "score", 3).select("task_type", "model_id", "rank", "odds"), "odds")


def k8_shrunk(s, d):
    return _r(dec.shrunk_ranking(_runs(s, d).where("mode is not null"), "task_type", "model_id", "verifier_score", 0.6, fine="mode"), "score")


def _models(s, d):
    return _runs(s, d).where("model_id is not null and task_type is not null").groupBy("task_type", "model_id").agg(F.avg("verifier_score").alias("q"), (F.avg("latency_ms") / 1000).alias("l"), F.avg(F.col("success").cast("double")).alias("s"))


def c31_support(s, d):
    claims = t30_claims(s, d).withColumn("a", tx.word_tokens(F.col("claim")))
    source = table(s, d, "cognitive_traces").dropDuplicates(["trace_id"]).select("trace_id", tx.word_tokens(F.col("input")).alias("b"))
    supported = df_.containment(F.col("a"), F.col("b"), STOP["en"] + STOP["es"]) >= 0.3
    return claims.join(source, "trace_id").groupBy("trace_id").agg(F.count("*").alias("claims"), F.count_if(supported).alias("supported"))


def c4_simhash_guard(s, d):
    t = spread(table(s, d, "texts").where("text is not null").select("text_id", "split", "text"))
    coded = t.select("text_id", F.lower(F.trim("split")).alias("split"), (F.length(tx.normalize_text(F.col("text"))) >= 12).alias("long"), simhash_of_text("text").alias("code"))
    t, _ = spill(coded, "codes")
    held = t.where("long and split in ('validation', 'test', 'dev', 'calibration')")
    return joins.hamming_guard(t.where("split = 'train'"), held, "text_id", "code", 6)


def a49_gate(s, d):
    m = _runs(s, d).where("model_id is not null").groupBy(F.col("model_id").alias("key")).agg(F.avg("verifier_score").alias("score"), F.avg("latency_ms").alias("latency"), F.count("*").alias("runs"))
    long = m.select("key", F.explode(F.array(F.struct(F.lit("score").alias("metric"), F.col("score").alias("number"), F.lit(None).cast("boolean").alias("flag")), F.struct(F.lit("latency").alias("metric"), F.col("latency").alias("number"), F.lit(None).cast("boolean").alias("flag")), F.struct(F.lit("many").alias("metric"), F.lit(None).cast("double").alias("number"), (F.col("runs") > 400).alias("flag")))).alias("x")).select("key", "x.*")
    return dec.gate(long, {"score": 0.7}, {"latency": 1200.0}, ["many"]).select("key", F.array_join("failures", ",").alias("failures"))


def a34_procedures(s, d):
    ev = table(s, d, "task_events").where("task_id is not null and event_type in ('route.selected', 'plan.created', 'tool.completed', 'answer.proposed')").select("task_id", "id", "created_at", "event_type").dropDuplicates(["id"])
    good = _runs(s, d).where("task_id is not null and success is not null").groupBy("task_id").agg(F.min("success").alias("good"))
    return _r(dec.mine_sequences(ev, "task_id", "event_type", ["created_at", "id"], good, 3, 0.2), "success")


def c29_cache(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("label").alias("space"), F.col("embedding").alias("v"), F.concat(F.lit("a"), "vec_id").alias("answer"), "vec_id")
    return _r(dec.cache_lookup(e.where("vec_id % 50 = 0").select("key", "space", "v"), e.where("vec_id % 3 = 0").drop("vec_id"), "key", "space", "v", "answer", 0.2), "similarity", digits=4)


def c29_cache_all(s, d):
    """c29 over every row as a cache entry; the requests' own keys are new, so that each is looked up by similarity."""
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("label").alias("space"), F.col("embedding").alias("v"), F.concat(F.lit("a"), "vec_id").alias("answer"), "vec_id")
    requests = e.where("vec_id % 50 = 0").select(F.concat(F.lit("q"), "key").alias("key"), "space", "v")
    return _r(dec.cache_lookup(requests, e.drop("vec_id"), "key", "space", "v", "answer", 0.2), "similarity", digits=4)


def c28_beliefs(s, d):
    o = _runs(s, d).where("task_type is not null and model_id is not null and verifier_score is not null and arm is not null").select("task_type", "model_id", "arm", (F.col("verifier_score") * 0.5).alias("s"))
    return _r(dec.belief_fold(o, ["task_type"], "model_id", "s", "arm"), "confidence", digits=5)


def c24_sample(s, d):
    x = _docs(s, d).where("source is not null and n_chars > 0")
    return dec.budget_sample(x, "source", "n_chars", 5000, "doc_id").select("doc_id")


def u2_merge(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    delta = s.createDataFrame([(3, "changed"), (99, "new")], "n_nationkey int, n_name string")
    return dec.delta_merge(n, delta.select(F.col("n_nationkey").cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name"), "n_nationkey")


def u1_first_wins(s, d):
    t = table(s, d, "texts").where("text is not null").select(F.sha2("text", 256).alias("h"), "text_id")
    parts = dec.ordered_union([t.where("text_id % 2 = 1"), t.where("text_id % 2 = 0")])
    return dec.first_wins(parts, "h", ["ordinal", "text_id"]).select("text_id", "ordinal")


def a37_regressions(s, d):
    base = _runs(s, d).where("arm = 'heuristic'").groupBy("task_type").agg(F.avg(F.col("success").cast("double")).alias("was"), F.avg("latency_ms").alias("l0"))
    now = _runs(s, d).where("arm = 'learned'").groupBy("task_type").agg(F.avg(F.col("success").cast("double")).alias("is"), F.avg("latency_ms").alias("l1"))
    return base.join(now, "task_type").select("task_type", (F.col("was") - F.col("is") > 0.03).alias("worse"), (F.col("l1") > 1.25 * F.col("l0")).alias("slower"))


def s1_round_trip(s, d):
    import os
    import uuid

    from quern.session import shared_dir

    path = os.path.join(shared_dir(s), f"shards-{uuid.uuid4().hex}")
    docs = _docs(s, d).select("doc_id", "source")
    files.write_shards(docs, path, "train", 300)
    return files.read_shards(s, path, "train", "doc_id bigint, source string").groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {
    "t5_scan_repair": lambda s, d: _docs(s, d).select("doc_id", F.length(df_.repair_scan_udf("text")).alias("n")),
    "t6_scan_clean": lambda s, d: _docs(s, d).select("doc_id", F.length(df_.clean_scan_udf("text")).alias("n")),
    "t7_chunks": lambda s, d: _docs(s, d).select("doc_id", F.size(df_.chunks_udf("text")).alias("n")),
    "t9_language_evidence": t9_language_evidence,
    "t10_oov": t10_oov,
    "t16_code_rules": t16_code,
    "t27_hashed_embedding": t27_embed,
    "t30_claims": t30_claims,
    "t30_containment": t30_containment,
    "t36_slug": t36_slug,
    "t37_contains": t37_contains,
    "t38_json_equality": t38_json,
    "h10_critical_path": h10_critical,
    "h12_lcs": h12_lcs,
    "s6_shard_round_trip": s1_round_trip,
    "s13_code_graph": s13_code_graph,
    "j10_profile_differences": lambda s, d: dec.profile_differences(_models(s, d), "model_id", "task_type", "s", "hyd-small-a", "hyd-small-b"),
    "j12_replay_containment": lambda s, d: joins.contains_rows(table(s, d, "nation"), table(s, d, "nation").where("n_nationkey <> 4")),
    "j15_best_per_id": lambda s, d: _r(joins.best_per_id([_models(s, d).select("model_id", F.col("q").alias("score")), _models(s, d).select("model_id", F.col("s").alias("score"))], "model_id", "score"), "score"),
    "j17_call_resolution": j17_call_resolution,
    "k2_rerank": k2_rerank,
    "k4_candidate_odds": k4_odds,
    "k6_weighted_rank": lambda s, d: _r(dec.weighted_rank(_models(s, d), ["task_type"], "model_id", {"q": 0.6, "s": 0.3, "l": -0.1}, 2).select("task_type", "model_id", "score", "rank"), "score"),
    "k8_shrunk_ranking": k8_shrunk,
    "c30_rank_changes": lambda s, d: dec.rank_changes(_models(s, d), ["task_type"], "model_id", {"q": 1.0}, {"s": 1.0}),
    "c31_provenance_support": c31_support,
    "c4_simhash_guard": c4_simhash_guard,
    "c15_projection": lambda s, d: dec.projection(table(s, d, "task_events").where("task_id is not null"), "task_id", "event_type", "created_at", [F.col("created_at"), F.col("id"), F.col("event_type")]).select("task_id", "events", "kinds", "first", "last", "last_kind"),
    "c24_budget_sample": c24_sample,
    "c28_belief_fold": c28_beliefs,
    "c29_cache_lookup": c29_cache,
    "c29_cache_lookup_all": c29_cache_all,
    "u1_first_wins": u1_first_wins,
    "u2_delta_merge": u2_merge,
    "u3_repeated_keys": lambda s, d: dec.repeated(table(s, d, "task_events"), F.col("id")),
    "u5_intersection": lambda s, d: table(s, d, "texts").where("split = 'train'").select(F.sha2("text", 256).alias("h")).intersect(table(s, d, "texts").where("split = 'test'").select(F.sha2("text", 256).alias("h"))),
    "a19_tail_bias": lambda s, d: _r(dec.tail_bias(_runs(s, d), ["model_id"], [F.desc("created_at"), F.desc("id"), F.desc("ingested_at")], "task_confidence", "verifier_score", 50), "bias"),
    "a21_conditional_rates": lambda s, d: _r(table(s, d, "cognitive_traces").groupBy("task_type").agg(F.avg(F.when(F.col("contaminated").isNotNull(), F.col("tool_failure").cast("double"))).alias("failing"), F.avg(F.when(~F.col("tool_failure"), F.col("verifier_score"))).alias("score")), "failing", "score"),
    "a33_mean_reward": lambda s, d: _r(_runs(s, d).groupBy("role", "mode").agg(F.coalesce(F.avg("user_feedback"), F.lit(0.5)).alias("q")), "q"),
    "a34_procedures": a34_procedures,
    "a37_regression_guard": a37_regressions,
    "a40_ablation": lambda s, d: _r(_runs(s, d).where("verifier_score is not null and role is not null").agg(F.avg("verifier_score").alias("base")).join(_runs(s, d).where("verifier_score is not null and role is not null").groupBy("role").agg(F.sum("verifier_score").alias("v"), F.count("*").alias("n"))).join(_runs(s, d).where("verifier_score is not null and role is not null").agg(F.sum("verifier_score").alias("tv"), F.count("*").alias("tn"))).select("role", (F.col("base") - (F.col("tv") - F.col("v")) / (F.col("tn") - F.col("n"))).alias("effect")), "effect"),
    "a46_temperature": lambda s, d: _r(dec.temperature(_runs(s, d).where("task_confidence > 0 and task_confidence < 1 and success is not null").withColumn("z", F.log(F.col("task_confidence") / (1 - F.col("task_confidence")))), "z", "success"), "temperature", "nll", digits=5),
    "a49_gate": a49_gate,
    "a50_validation": lambda s, d: dec.repeated(table(s, d, "source_files").where("text is not null"), F.sha2("text", 256)).select("n").groupBy("n").agg(F.count("*").alias("texts")),
    "c13_compile": lambda s, d: records.search(table(s, d, "cognitive_traces")).where("length(final_answer) > 0 and verifier_score >= 0.9").dropDuplicates(["trace_id"]).select("trace_id", F.to_json(F.struct(F.struct(F.lit("assistant").alias("role"), F.length("final_answer").alias("content")).alias("m"))).alias("row")),
}


_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: w <> '')"
_MODELS = "m as (select task_type, model_id, avg(verifier_score) as q, avg(latency_ms) / 1000 as l, avg(success::int) as s from inference_runs where model_id is not null and task_type is not null group by all)"
def _hits(lang):
    return f"len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in STOP[lang])})))"


SQL = {
    "t9_language_evidence": "with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from documents where text is not null), h as (select doc_id, len(w) as n, greatest(" + ", ".join(f"({_hits(x)}, '{x}')" for x in sorted(STOP)) + ") as m from d) select doc_id, case when m[1] >= 2 and m[1] >= 0.08 * n then m[2] end as language from h",
    "t36_slug": r"select n_nationkey, trim(regexp_replace(lower(n_name), '[^\p{L}\p{N}]+', '-', 'g'), '-') as slug from nation",
    "t37_contains": "select doc_id, round((contains(lower(text), 'registro')::int + contains(lower(text), 'index')::int + contains(lower(text), 'plazo')::int) / 3.0, 6)::double as score from documents where text is not null",
    "s6_shard_round_trip": "select source, count(*) as n from documents where text is not null group by 1",
    "j10_profile_differences": f"with {_MODELS} select a.task_type, case when b.s - a.s > 0.02 then 'better' when b.s - a.s < -0.02 then 'worse' else 'same' end as change from m a join m b on a.task_type = b.task_type where a.model_id = 'hyd-small-a' and b.model_id = 'hyd-small-b'",
    "j12_replay_containment": "select * from nation where n_nationkey = 4",
    "j15_best_per_id": f"with {_MODELS} select model_id, round(greatest(max(q), max(s)), 6) as score from m group by 1",
    "k4_candidate_odds": "with c as (select task_type, model_id, round(avg(verifier_score), 6) as score from inference_runs where verifier_score is not null and model_id is not null group by all), r as (select *, row_number() over (partition by task_type order by score desc, model_id) as rank from c), t as (select * from r where rank <= 3) select task_type, model_id, rank::int as rank, round(exp(4 * score) / (sum(exp(4 * score)) over (partition by task_type) + exp(4 * 0.35)), 6) as odds from t",
    "k6_weighted_rank": f"with {_MODELS}, r as (select task_type, model_id, 0.6 * coalesce(q, 0) + 0.3 * coalesce(s, 0) - 0.1 * coalesce(l, 0) as score from m), x as (select *, row_number() over (partition by task_type order by score desc, model_id) as rank from r) select task_type, model_id, round(score, 6) as score, rank::int as rank from x where rank <= 2",
    "k8_shrunk_ranking": "with r as (select * from inference_runs where mode is not null and verifier_score is not null), c as (select task_type, model_id, (sum(verifier_score) + 5 * 0.6) / (count(*) + 5) as coarse from r group by all), f as (select task_type, mode, model_id, (sum(verifier_score) + 5 * 0.6) / (count(*) + 5) as own, count(*) as n from r group by all) select f.task_type, f.mode, f.model_id, round(case when n >= 3 then own else coarse end, 6) as score from f join c on f.task_type = c.task_type and f.model_id = c.model_id",
    "c30_rank_changes": f"with {_MODELS}, r as (select task_type, model_id, row_number() over (partition by task_type order by coalesce(q, 0) desc, model_id) as a, row_number() over (partition by task_type order by coalesce(s, 0) desc, model_id) as b from m), x as (select task_type, max(model_id) filter (where a = 1) as was, max(model_id) filter (where b = 1) as now from r group by 1) select * from x where was <> now",
    "c15_projection": "select task_id, count(*) as events, count(distinct event_type) as kinds, min(created_at) as first, max(created_at) as last, arg_max(event_type, (created_at, id, event_type)) as last_kind from task_events where task_id is not null group by 1",
    "c24_budget_sample": "with x as (select *, sum(n_chars) over (partition by source) as total, ('0x' || substr(sha256(doc_id::varchar), 1, 8))::ubigint / 4294967296.0 as u from documents where text is not null and source is not null and n_chars > 0) select doc_id from x where u < 5000 / total",
    "c28_belief_fold": "with f as (select task_type, model_id, arm, max(verifier_score * 0.5) as s from inference_runs where task_type is not null and model_id is not null and verifier_score is not null and arm is not null group by all), p as (select task_type, model_id, 1 - product(1 - least(s, 0.999)) as pos from f group by all), c as (select task_type, model_id, pos * exp(sum(ln(1 - least(pos, 0.999))) over (partition by task_type) - ln(1 - least(pos, 0.999))) as c from p) select task_type, model_id, round(c, 5) as confidence, case when c < 0.05 then 'rejected' when c >= 0.9 then 'verified' when c >= 0.6 then 'supported' else 'hypothesis' end as status from c",
    "c29_cache_lookup": "with e as (select vec_id, label, embedding::double[] as v from embeddings), r as (select * from e where vec_id % 50 = 0), c as (select * from e where vec_id % 3 = 0), x as (select r.vec_id::varchar as key, 'a' || r.vec_id as answer, 1.0::double as similarity from r where r.vec_id % 3 = 0), n as (select r.vec_id, c.vec_id as k, list_cosine_similarity(r.v, c.v) as sim from r join c on r.label = c.label where r.vec_id % 3 <> 0), y as (select *, row_number() over (partition by vec_id order by sim desc, k::varchar desc) as rn from n where sim >= 0.2) select key, answer, round(similarity, 4) as similarity from x union all select vec_id::varchar, 'a' || k, round(sim, 4) from y where rn = 1",
    "u1_first_wins": "with t as (select sha256(text) as h, text_id, case when text_id % 2 = 1 then 0 else 1 end as ordinal from texts where text is not null) select text_id, ordinal::int as ordinal from (select *, row_number() over (partition by h order by ordinal, text_id) as rn from t) where rn = 1",
    "u2_delta_merge": "select n_nationkey, n_name from nation where n_nationkey not in (3, 99) union all values (3, 'changed'), (99, 'new')",
    "u3_repeated_keys": "select id as key, count(*) as n from task_events group by 1 having count(*) > 1",
    "u5_intersection": "select sha256(text) as h from texts where split = 'train' intersect select sha256(text) from texts where split = 'test'",
    "a19_tail_bias": "with r as (select model_id, verifier_score - task_confidence as e, row_number() over (partition by model_id order by created_at desc, id desc, ingested_at desc) as rn from inference_runs where task_confidence is not null and verifier_score is not null) select model_id, round(avg(e), 6) as bias, count(*) as n from r where rn <= 50 group by 1 having count(*) >= 5",
    "a21_conditional_rates": "select task_type, round(avg(tool_failure::int) filter (where contaminated is not null), 6) as failing, round(avg(verifier_score) filter (where not tool_failure), 6) as score from cognitive_traces group by 1",
    "a33_mean_reward": "select role, mode, round(coalesce(avg(user_feedback), 0.5), 6) as q from inference_runs group by all",
    "a37_regression_guard": "with g as (select task_type, avg(success::int) filter (where arm = 'heuristic') as was, avg(latency_ms) filter (where arm = 'heuristic') as l0, avg(success::int) filter (where arm = 'learned') as now, avg(latency_ms) filter (where arm = 'learned') as l1, count(*) filter (where arm = 'heuristic') as a, count(*) filter (where arm = 'learned') as b from inference_runs group by 1) select task_type, was - now > 0.03 as worse, l1 > 1.25 * l0 as slower from g where a > 0 and b > 0 and task_type is not null",
    "a40_ablation": "with r as (select role, verifier_score as v from inference_runs where verifier_score is not null and role is not null), t as (select avg(v) as base, sum(v) as tv, count(*) as tn from r), g as (select role, sum(v) as v, count(*) as n from r group by 1) select role, round(base - (tv - v) / (tn - n), 6) as effect from g, t",
    "a49_gate": "with m as (select model_id as key, avg(verifier_score) as score, avg(latency_ms) as latency, count(*) > 400 as many from inference_runs where model_id is not null group by 1) select key, array_to_string(list_filter([case when not coalesce(score >= 0.7, false) then 'score' end, case when not coalesce(latency <= 1200, false) then 'latency' end, case when not many then 'many' end], lambda x: x is not null), ',') as failures from m",
    "a50_validation": "select n, count(*) as texts from (select text, count(*) as n from source_files where text is not null group by 1 having count(*) > 1) group by 1",
}
