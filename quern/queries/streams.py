"""Streams over the events table, drained once; SQL covers the windows that the watermark has closed."""

from pyspark.sql import functions as F

from quern.functions.html import page_text
from quern.sources import files
from quern.sources.tables import table
from quern.streaming import streams


def _events(s, d):
    return streams.tail(s, f"{d}/events.parquet*", table(s, d, "events").schema, "ts")


def s16_prometheus(s, d):
    r = table(s, d, "inference_runs").where("model_id is not null and latency_ms is not null")
    lines = r.select(F.concat(F.lit('latency_ms{model="'), "model_id", F.lit('"} '), F.round("latency_ms", 2).cast("string")).alias("value"))
    return files.prometheus(lines).select("metric", F.round("total", 2).alias("total"))


def s14_html(s, d):
    n = table(s, d, "nation")
    html = F.concat(F.lit("<html><head><title>x</title></head><body><nav>menu</nav><p>Land "), "n_name", F.lit(" &amp; "), F.col("n_regionkey").cast("string"), F.lit("</p><a href='/n/"), F.col("n_nationkey").cast("string"), F.lit("'>more</a><script>no()</script></body></html>"))
    return n.select("n_nationkey", page_text(html).alias("p")).select("n_nationkey", "p.text", F.element_at("p.links", 1).alias("link"))


QUERIES = {
    "r_tumbling": lambda s, d: streams.drain(streams.tumbling(_events(s, d), "ts", ["event_type"], "1 hour")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"),
    "r_sliding": lambda s, d: streams.drain(streams.tumbling(_events(s, d), "ts", [], "1 hour", slide="30 minutes")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n"),
    "r_sessions": lambda s, d: streams.drain(streams.sessions(_events(s, d), "ts", "user_id", "30 minutes")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"),
    "r_once": lambda s, d: streams.drain(streams.once(_events(s, d), "event_id", "ts")).groupBy("event_type").agg(F.count("*").alias("n")),
    "r_running": lambda s, d: streams.drain(streams.running(_events(s, d), ["event_type"], n=F.count("*"), total=F.sum("value")), "complete").select("event_type", "n", F.round("total", 2).alias("total")),
    "r_spans": lambda s, d: streams.drain(streams.spans(_events(s, d), "user_id", "ts", "event_type", "click", "purchase")).groupBy("state").agg(F.count("*").alias("n")),
    "r7_transitions": lambda s, d: streams.drain(streams.transitions(_events(s, d), "user_id", "ts", "event_type", {("*", "click"): "clicked", ("*", "purchase"): "bought", ("*", "error"): "failed"}, "new", order="event_id")).groupBy("before", "after").agg(F.count("*").alias("n")),
    "s9_flat_columns": lambda s, d: files.flat_columns(table(s, d, "source_files").select("file_id", "detected_licenses")),
    "s11_log_range": lambda s, d: files.read_log(files.numbered(table(s, d, "task_events").where("source is not null").select("source", "id", "created_at", "ingested_at"), "source", [F.col("created_at"), F.col("id"), F.col("ingested_at")]), 10, 20).select("source", "id", "seq"),
    "s14_html_text": s14_html,
    "s16_prometheus": s16_prometheus,
}

_CLOSED = "select max(ts) - interval 1 hour as w from events"
SQL = {
    "r_tumbling": f"with x as (select date_trunc('hour', ts) as start, event_type from events) select start, event_type, count(*) as n from x group by 1, 2 having start + interval 1 hour <= ({_CLOSED})",
    "r_sliding": f"with x as (select ts, unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as start from events) select start, count(*) as n from x group by 1 having start + interval 1 hour <= ({_CLOSED})",
    "r_sessions": f"with m as (select *, case when ts >= lag(ts) over w + interval 30 minutes or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from m) select user_id, min(ts) as start, count(*) as n from g group by user_id, s having max(ts) + interval 30 minutes <= ({_CLOSED})",
    "r_once": "select event_type, count(*) as n from events group by 1",
    "r_running": "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1",
    "r7_transitions": "with x as (select user_id, ts, event_id, case event_type when 'click' then 'clicked' when 'purchase' then 'bought' else 'failed' end as after from events where event_type in ('click', 'purchase', 'error')), m as (select after, coalesce(lag(after) over (partition by user_id order by ts, event_id), 'new') as before from x) select before, after, count(*) as n from m where before <> after group by all",
    "s11_log_range": "select source, id, seq from (select source, id, row_number() over (partition by source order by created_at, id, ingested_at) as seq from task_events where source is not null) where seq > 10 and seq <= 20",
    "s14_html_text": "select n_nationkey, 'Land ' || n_name || ' & ' || n_regionkey || chr(10) || 'more' as text, '/n/' || n_nationkey as link from nation",
    "s16_prometheus": "select 'latency_ms' as metric, round(sum(round(latency_ms, 2)), 2) as total from inference_runs where model_id is not null",
}
