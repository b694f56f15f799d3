"""Text measures, cleaning, record store and dataset queries, and graphs."""

from pyspark.sql import functions as F

from quern.functions import stats
from quern.functions import text as tx
from quern.functions.hashing import canonical_json, hash_bucket, sha256, simhash_of_text
from quern.operators import components as graph
from quern.operators import dedup, joins, records
from quern.session import spill, spread
from quern.sources.tables import table


def _docs(s, d):
    return spread(table(s, d, "documents"))


def _r(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def t11_style(s, d):
    x = _docs(s, d).where("text is not null")
    return _r(x.select("doc_id", *[c.alias(n) for n, c in tx.style_measures(F.col("text")).items()]), "mean_word", "symbol_ratio", "alpha_words", "ellipsis_lines", "bullet_lines")


def t12_line_repetition(s, d):
    ls = tx.lines(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(ls).alias("lines"), F.size(tx.duplicates(ls)).alias("dup"), tx.total_length(tx.duplicates(ls)).alias("dup_chars"))


def t13_top_ngram(s, d):
    r = tx.ngram_repetition(F.col("text"))
    return _docs(s, d).select("doc_id", *[F.round(r[i], 6).alias(n) for i, n in enumerate(("top2", "top3", "top4"))])


def t14_dup_ngram(s, d):
    r = tx.ngram_repetition(F.col("text"))
    return _docs(s, d).select("doc_id", F.round(r[3], 6).alias("dup5"), F.round(r[8], 6).alias("dup10"))


def quality_reasons(s, d):
    judged = tx.with_quality(_docs(s, d).where("text is not null").select("doc_id", "text"), "text", min_words=20)
    return judged.groupBy(F.coalesce("quality", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def j4_contaminated(s, d):
    docs = _docs(s, d)
    held = docs.where("source in ('Router evaluations', 'Seed prompts')")
    return dedup.contaminated(docs.where("source is null or source not in ('Router evaluations', 'Seed prompts')"), held, "doc_id", "text")


def j5_simhash(s, d):
    t, _ = spill(spread(table(s, d, "texts").where("text is not null").select("text_id", "text")).select("text_id", simhash_of_text("text").alias("code")), "codes")
    return joins.hamming_pairs(t, "text_id", "code", 3, members=True)


def c2_greedy(s, d):
    docs = _docs(s, d).where("length(text) > 0")
    return dedup.greedy_keep(docs.select(F.col("doc_id").alias("id")), dedup.near_edges(docs, "doc_id", "text")).groupBy("kept").agg(F.count("*").alias("n"))


def c1_funnel(s, d):
    name = lambda c: tx.normalize_text(F.col(c))
    law = table(s, d, "source_specs").where("kind = 'boe'").select(name("name").alias("__name"), F.lit(True).alias("law")).distinct()
    docs = _docs(s, d)
    kinds = docs.withColumn("__name", name("source")).join(F.broadcast(law), "__name", "left").withColumn("law", F.coalesce("law", F.lit(False)))
    out = dedup.funnel(kinds.where("source is null or source <> 'Seed prompts'"), "doc_id", "text", docs.where("source = 'Seed prompts'"), formulaic="law")
    return out.groupBy("reason", "split").agg(F.count("*").alias("n"))


def _tree(s, d):
    return table(s, d, "part").where("p_partkey > 0").select(F.floor(F.col("p_partkey") / 2).cast("bigint").alias("u"), F.col("p_partkey").cast("bigint").alias("v"))


def _ring(s, d):
    c = table(s, d, "customer").where("c_custkey < 150")
    return c.select(F.col("c_custkey").cast("bigint").alias("u"), ((F.col("c_custkey") * 7 + 3) % 150).cast("bigint").alias("v")).where("u <> v")


def u6_closure(s, d):
    start = s.createDataFrame([(5,)], "node bigint")
    return graph.reachable(_tree(s, d), start)


def u8_paths(s, d):
    return graph.reachable(_ring(s, d), s.createDataFrame([(1,)], "node bigint"), undirected=True)


def j9_neighbours(s, d):
    return graph.reachable(_ring(s, d), s.createDataFrame([(1,)], "node bigint"), undirected=True, max_depth=2).where("depth <= 2")


def _whole_ring(s, d):
    """The ring over all customers: its length is the first number after the largest key."""
    c = table(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("u"))
    n = c.agg((F.max("u") + 1).alias("n"))
    return c.join(F.broadcast(n)).select("u", ((F.col("u") * 7 + 3) % F.col("n")).alias("v")).where("u <> v")


def u8_paths_all(s, d):
    return graph.reachable(_whole_ring(s, d), s.createDataFrame([(1,)], "node bigint"), undirected=True)


def j9_neighbours_all(s, d):
    return graph.reachable(_whole_ring(s, d), s.createDataFrame([(1,)], "node bigint"), undirected=True, max_depth=2).where("depth <= 2")


def c8_impact(s, d):
    return graph.impact(_tree(s, d), s.createDataFrame([(7,)], "node bigint"), {"1": "one", "2": "two"})


def u7_components(s, d):
    f = table(s, d, "families").where("trim(hash) <> ''").select("text_id", F.regexp_replace(F.lower(F.trim("hash")), "^sha256:", "").alias("h"))
    star = f.join(f.groupBy("h").agg(F.min("text_id").alias("m")), "h").where("text_id <> m")
    return graph.components(star.select(F.col("m").alias("u"), F.col("text_id").alias("v")))


def a2_corpus_stats(s, d):
    x = _docs(s, d)
    return x.agg(F.count("*").alias("docs"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count_if(F.col("license").isNull()).alias("unlicensed"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"))


def f2_reasons(s, d):
    reason = records.first_failure([("no_text", F.length("text") > 0), ("no_licence", F.col("license").isNotNull()), ("language", F.col("lang").isin("es", "en")), ("short", F.col("n_chars") >= 300)])
    return _docs(s, d).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def u4_leakage(s, d):
    t = table(s, d, "texts").where("text is not null").select(F.lower(F.trim("split")).alias("split"), F.sha2("text", 256).alias("h"))
    return records.leakage(t.where("split <> ''"), "h", "split").select("h", "n", F.array_join("splits", ",").alias("splits"))


def j2_without(s, d):
    deleted = table(s, d, "tasks").where("deleted_at is not null").select(F.col("id").alias("task_id"))
    return records.without(table(s, d, "inference_runs").where("task_id is not null"), deleted, "task_id").groupBy("task_type").agg(F.count("*").alias("n"))


def h1_canonical(s, d):
    p = table(s, d, "task_events").where("payload is not null").select("id", canonical_json("payload").alias("c")).where("c is not null")
    return p.groupBy(F.substring(sha256(F.col("c")), 1, 2).alias("head")).agg(F.count("*").alias("n"))


def h2_merkle(s, d):
    from quern.operators.merkle import merkle_root

    leaves = table(s, d, "orders").select(F.col("o_orderstatus").alias("stream"), F.row_number().over(_by("o_orderstatus", "o_orderkey")).alias("pos"), sha256(F.col("o_orderpriority")).alias("leaf"))
    return merkle_root(leaves.withColumn("pos", F.col("pos") - 1), "stream", "pos", "leaf")


def _by(key, order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


def t29_jaccard(s, d):
    x = _docs(s, d).where("length(text) > 0").select("doc_id", F.array_distinct(tx.word_tokens(F.col("text"))).alias("w"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return x.join(y, "doc_id").select("doc_id", F.round(tx.jaccard_tokens(F.col("w"), F.col("v")), 6).alias("jaccard"))


def licences(s, d):
    x = _docs(s, d).where("license is not null").select(F.explode(records.licence_ids(F.col("license"))).alias("licence"))
    return x.groupBy("licence").agg(F.count("*").alias("n"))


QUERIES = {
    "t1_exact_duplicates": lambda s, d: dedup.exact_groups(_docs(s, d), "doc_id", "text"),
    "t2_normalize": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.length(tx.normalize_corpus("text")).alias("n")),
    "t3_fold_accents": lambda s, d: _docs(s, d).where("length(text) > 0").select("doc_id", F.size(F.array_distinct(tx.words(tx.fold_accents("text")))).alias("n")),
    "t4_basic_reason": lambda s, d: _docs(s, d).groupBy(F.coalesce(tx.basic_reason(F.col("text")), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n")),
    "t8_word_counts": lambda s, d: _docs(s, d).select("doc_id", F.size(tx.words(F.col("text"))).alias("n")),
    "t11_style": t11_style,
    "t12_line_repetition": t12_line_repetition,
    "t13_top_ngram": t13_top_ngram,
    "t14_dup_ngram": t14_dup_ngram,
    "t15_quality_reasons": quality_reasons,
    "t21_tiers": lambda s, d: table(s, d, "cognitive_traces").where("verifier_score is not null").groupBy(stats.tier(F.col("verifier_score"), ~F.coalesce("contaminated", F.lit(True))).alias("tier")).agg(F.count("*").alias("n")),
    "t22_buckets": lambda s, d: table(s, d, "inference_runs").where("complexity is not null").groupBy(stats.difficulty_bucket(F.col("complexity")).alias("difficulty"), stats.complexity_bucket(F.col("complexity")).alias("complexity")).agg(F.count("*").alias("n")),
    "t29_token_jaccard": t29_jaccard,
    "j2_anti_join": j2_without,
    "j4_contaminated": j4_contaminated,
    "j5_simhash_pairs": j5_simhash,
    "c1_funnel": c1_funnel,
    "c2_greedy_near_duplicates": c2_greedy,
    "c8_impact": c8_impact,
    "c9_snapshot_hash": lambda s, d: records.snapshot_hash(table(s, d, "tasks"), "id", "status"),
    "c10_synthetic_cap": lambda s, d: records.synthetic_cap(_docs(s, d), F.coalesce(F.col("source") == "Trace digests", F.lit(False)), 0.02, "doc_id").groupBy(F.coalesce(F.col("source") == "Trace digests", F.lit(False)).alias("synthetic")).agg(F.count("*").alias("n")),
    "c11_quota": lambda s, d: records.quota(_docs(s, d), "lang", {"es": 0.5, "en": 0.3, "de": 0.2}, "doc_id").select("lang", "doc_id"),
    "c12_family_split": lambda s, d: records.family_split(table(s, d, "families").where("hash is not null"), F.col("hash"), {"train": 0.8, "validation": 0.1, "test": 0.1}, "seed").groupBy("split").agg(F.count("*").alias("n")),
    "c21_round_robin": lambda s, d: records.round_robin(_docs(s, d).where("source is not null"), "source", "doc_id", 100).select("doc_id", "source"),
    "c22_reserved": lambda s, d: records.reserve(_docs(s, d), ["lang", "source"], "doc_id", 3).where("reserved").select("doc_id"),
    "c23_attribution": lambda s, d: records.attribution(_docs(s, d), "license", "source"),
    "f1_search": lambda s, d: records.search(table(s, d, "task_events"), contains={"payload": "MS"}, prefix={"event_type": "task"}, since=F.lit("2025-02-01").cast("timestamp_ntz"), ts="created_at").select("id", "event_type", "created_at"),
    "f2_first_failure": f2_reasons,
    "f6_licence_ids": licences,
    "h1_canonical_json": h1_canonical,
    "h2_merkle": h2_merkle,
    "h4_holdout": lambda s, d: _docs(s, d).where(hash_bucket(F.col("doc_id").cast("string"), 100) < 2).select("doc_id"),
    "a2_corpus_stats": a2_corpus_stats,
    "u4_leakage": u4_leakage,
    "u6_closure": u6_closure,
    "u7_components": u7_components,
    "u8_shortest_paths": u8_paths,
    "u8_shortest_paths_all": u8_paths_all,
    "j9_neighbours": j9_neighbours,
    "j9_neighbours_all": j9_neighbours_all,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"
_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '')"
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), lambda w: w <> '')"
_TREE = "edges as (select (p_partkey // 2)::bigint as u, p_partkey::bigint as v from part where p_partkey > 0)"
_RING = "e0 as (select c_custkey::bigint as u, ((c_custkey * 7 + 3) % 150)::bigint as v from customer where c_custkey < 150), edges as (select u, v from e0 where u <> v union select v, u from e0 where u <> v)"
SQL = {
    "t1_exact_duplicates": r"with h as (select doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as t from documents where text is not null) select doc_id, min(doc_id) over (partition by t) as first, count(*) over (partition by t) as copies from h",
    "t8_word_counts": f"select doc_id, len({_WORDS})::int as n from documents",
    "t12_line_repetition": f"with l as (select doc_id, {_LINES} as ls from documents), x as (select doc_id, unnest(ls) as line from l), g as (select doc_id, line, count(*) as c from x group by all), a as (select doc_id, sum(c) filter (where c > 1) as dup, sum(c * length(line)) filter (where c > 1) as chars from g group by 1) select l.doc_id, len(ls)::int as lines, coalesce(dup, 0)::int as dup, coalesce(chars, 0)::int as dup_chars from l left join a using (doc_id)",
    "t21_tiers": "select case when verifier_score > 0.92 and not coalesce(contaminated, true) then 'gold' when verifier_score >= 0.8 then 'silver' when verifier_score >= 0.6 then 'bronze' else 'raw' end as tier, count(*) as n from cognitive_traces where verifier_score is not null group by 1",
    "t22_buckets": "select case when complexity < 0.34 then 'easy' when complexity < 0.67 then 'medium' else 'hard' end as difficulty, case when complexity < 0.3 then 'low' when complexity < 0.6 then 'medium' when complexity < 0.8 then 'high' else 'extreme' end as complexity, count(*) as n from inference_runs where complexity is not null group by 1, 2",
    "j2_anti_join": "select task_type, count(*) as n from inference_runs where task_id is not null and task_id not in (select id from tasks where deleted_at is not null) group by 1",
    "c8_impact": f"with recursive {_TREE}, r(node) as (select v from edges where u = 7 union select e.v from r join edges e on e.u = r.node), dep as (select node, floor(log2(node / 7.0 + 1e-9))::int as depth from r) select case when node::varchar like '2%' then 'two' when node::varchar like '1%' then 'one' else 'record' end as kind, count(*) as n, max(floor(log2(node + 0.5)) - floor(log2(7.5)))::int as depth from dep group by 1",
    "c9_snapshot_hash": "with l as (select sha256(concat_ws('|', id, coalesce(status, ''))) as h from tasks), a as (select substr(h, 1, 4) as b, sha256(string_agg(h, '' order by h)) as h, count(*) as n from l group by 1), c as (select substr(b, 1, 2) as b, sha256(string_agg(h, '' order by b)) as h, sum(n) as n from a group by 1) select sum(n)::bigint as rows, sha256(string_agg(h, '' order by b)) as hash from c",
    "c11_quota": "with c as (select lang, count(*) as c from documents where lang in ('es', 'en', 'de') group by 1), m(lang, w) as (values ('es', 0.5::double), ('en', 0.3::double), ('de', 0.2::double)), n as (select min(floor(c / w)) as n from c join m using (lang)), r as (select lang, doc_id, row_number() over (partition by lang order by sha256('s' || doc_id::varchar), doc_id) as rank from documents where lang in ('es', 'en', 'de')) select lang, doc_id from r join m using (lang), n where rank <= greatest(1, round_even(n * w, 0))",
    "c12_family_split": "with h as (select ('0x' || substr(sha256('seed:' || hash), 1, 8))::ubigint / 4294967296.0 as h from families where hash is not null) select case when h < 0.8 then 'train' when h < 0.9 then 'validation' else 'test' end as split, count(*) as n from h group by 1",
    "c21_round_robin": "with r as (select doc_id, source, row_number() over (partition by source order by sha256('s' || doc_id::varchar), doc_id) as rank from documents where source is not null) select doc_id, source from r order by rank, source limit 100",
    "c22_reserved": "select doc_id from (select doc_id, row_number() over (partition by lang, source order by doc_id) as rn from documents) where rn <= 3",
    "c23_attribution": "select license, array_to_string(list_sort(list(distinct source)), '; ') as sources, count(*) as n from documents where license is not null group by 1",
    "f1_search": "select id, event_type, created_at from task_events where contains(lower(payload), 'ms') and (event_type = 'task' or event_type like 'task.%') and created_at >= timestamp '2025-02-01'",
    "f2_first_failure": "select case when coalesce(length(text), 0) = 0 then 'no_text' when license is null then 'no_licence' when not coalesce(lang in ('es', 'en'), false) then 'language' when not coalesce(n_chars >= 300, false) then 'short' else 'kept' end as reason, count(*) as n from documents group by 1",
    "f6_licence_ids": r"with x as (select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(license, '[;,()\s]+'), lambda x: x <> '' and x not in ('OR', 'AND', 'WITH') and regexp_matches(x, '[A-Z0-9]')))) as licence from documents where license is not null) select licence, count(*) as n from x group by 1",
    "h4_holdout": "select doc_id from documents where ('0x' || substr(sha256(doc_id::varchar), 1, 8))::ubigint % 100 < 2",
    "a2_corpus_stats": "select count(*) as docs, count(*) filter (where text is null) as null_texts, count(distinct source) as sources, sum(n_chars)::bigint as chars, count(*) filter (where license is null) as unlicensed, count(distinct text) as distinct_texts from documents",
    "u4_leakage": "with t as (select sha256(text) as h, lower(trim(split)) as split from texts where text is not null and trim(split) <> '') select h, count(*) as n, array_to_string(list_sort(list(distinct split)), ',') as splits from t group by 1 having count(distinct split) > 1",
    "u6_closure": f"with recursive {_TREE}, r(node, depth) as (select 5::bigint, 0 union all select e.v, depth + 1 from r join edges e on e.u = r.node) select node, depth from r",
    "u7_components": "with recursive f as (select text_id, regexp_replace(lower(trim(hash)), '^sha256:', '') as h from families where trim(hash) <> ''), e as (select distinct a.text_id as u, b.text_id as v from f a join f b using (h) where a.text_id <> b.text_id), r(a, b) as (select u, u from e union select r.a, e.v from r join e on r.b = e.u) select a as node, min(b) as root from r group by a",
    "u8_shortest_paths": f"with recursive {_RING}, r(node, depth) as (select 1::bigint, 0 union select e.v, depth + 1 from r join edges e on e.u = r.node where depth < 40) select node, min(depth)::int as depth from r group by 1",
    "j9_neighbours": f"with recursive {_RING}, r(node, depth) as (select 1::bigint, 0 union select e.v, depth + 1 from r join edges e on e.u = r.node where depth < 2) select node, min(depth)::int as depth from r group by 1",
}
SQL["j4_contaminated"] = f"with x as (select doc_id, source, {_TOKENS} as w from documents where source is not null), g as (select doc_id, source in ('Router evaluations', 'Seed prompts') as held, array_to_string(w[i:i + 12], ' ') as g from x, unnest(range(1, len(w) - 11)) as r(i)) select distinct doc_id from g where not held and g in (select g from g where held)"
SQL["c10_synthetic_cap"] = "with x as (select coalesce(source = 'Trace digests', false) as synthetic from documents), n as (select count(*) filter (where not synthetic) as real from x) select synthetic, least(count(*), case when synthetic then floor(0.02 / (1 - 0.02) * any_value(real)) else 1000000000 end)::bigint as n from x, n group by synthetic"
