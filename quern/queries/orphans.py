"""Queries of the reference check."""

from quern.operators import orphans as op
from quern.sources.tables import table


def found(spark, sf_dir):
    return op.orphans(table(spark, sf_dir, "tasks"), {n: table(spark, sf_dir, n) for n in ("task_events", "inference_runs")})


QUERIES = {
    "p1_found": lambda spark, sf_dir: found(spark, sf_dir).select("child_table", "id", "cause"),
    "p1_report": lambda spark, sf_dir: op.orphan_report(found(spark, sf_dir)),
}

_KEY = r"nullif(nullif(regexp_replace(regexp_replace(translate(lower({c}), '{{}}-', ''), '^\s+|\s+$', '', 'g'), '^urn:uuid:', ''), ''), repeat('0', 32))"
_FOUND = f"""
with parent as (
  select {_KEY.format(c="id")} as k, min(ingested_at) as first_in,
         arg_max(deleted_at is not null, (ingested_at, deleted_at is not null)) as deleted
  from tasks group by 1),
raw as (
  select 'task_events' as child_table, id, task_id, ingested_at, created_at from task_events
  union all select 'inference_runs', id, task_id, ingested_at, created_at from inference_runs),
child as (
  select child_table, id, min(ingested_at) as ingested_at, arg_min({_KEY.format(c="task_id")}, ingested_at) as k,
         arg_min(strftime(created_at, '%Y-%m'), ingested_at) as month
  from raw where id is not null group by 1, 2),
judged as (
  select c.child_table, c.id, c.month,
         case when p.k is null then 'missing' when p.deleted then 'deleted' when c.ingested_at < p.first_in then 'late' end as cause
  from child c left join parent p on c.k = p.k where c.k is not null)
"""
SQL = {
    "p1_found": _FOUND + "select child_table, id, cause from judged where cause is not null",
    "p1_report": _FOUND + "select child_table, month, cause, count(*) as n from judged where cause is not null group by all",
}
