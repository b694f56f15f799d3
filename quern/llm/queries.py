"""Queries of the training-data operators (names pN_...), with SQL where DuckDB can express them."""

from pyspark.sql import functions as F

from quern.llm import language, mixing, neardup, pairs, secrets, splits, tokenizer
from quern.sources.tables import table


def p2_found(spark, sf_dir):
    return secrets.found(table(spark, sf_dir, "source_files"))


def p2_findings(spark, sf_dir):
    return secrets.findings(table(spark, sf_dir, "source_files"))


def p2_redacted(spark, sf_dir):
    return secrets.redacted(table(spark, sf_dir, "source_files"))


def p3_found(spark, sf_dir):
    return splits.groups(table(spark, sf_dir, "texts"), table(spark, sf_dir, "families"))


def p3_assigned(spark, sf_dir):
    return splits.assign(table(spark, sf_dir, "texts"), table(spark, sf_dir, "families"))


def p3_shares(spark, sf_dir):
    return splits.shares(p3_assigned(spark, sf_dir))


def p3_contradictions(spark, sf_dir):
    return splits.contradictions(table(spark, sf_dir, "texts"), table(spark, sf_dir, "families"))


def p4_found(spark, sf_dir):
    return pairs.found(table(spark, sf_dir, "cognitive_traces"), table(spark, sf_dir, "documents"))


def p4_flags(spark, sf_dir):
    return pairs.flags(table(spark, sf_dir, "cognitive_traces"), table(spark, sf_dir, "documents"))


def p4_report(spark, sf_dir):
    return pairs.report(table(spark, sf_dir, "cognitive_traces"), table(spark, sf_dir, "documents"))


def p5_found(spark, sf_dir):
    return neardup.found(table(spark, sf_dir, "texts"))


def p5_report(spark, sf_dir):
    return neardup.report(table(spark, sf_dir, "texts"))


def p5_classes(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "texts"))


def p6_ids(spark, sf_dir):
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark, sf_dir):
    """Documents, those whose ids give the text back, and ids, per source."""
    docs = table(spark, sf_dir, "documents")
    encoded = tokenizer.encode(docs, keep=["doc_id", "source", "text"])
    back = tokenizer.decode(encoded, keep=["doc_id", "source"]).withColumnRenamed("text", "back")
    return back.join(docs.select("doc_id", "text"), "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("back") == F.coalesce("text", F.lit(""))).alias("exact"))


def _mixed(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_records(spark, sf_dir):
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark, sf_dir):
    return _mixed(spark, sf_dir)[1]


def p8_found(spark, sf_dir):
    return language.found(table(spark, sf_dir, "documents"))


def p8_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.segments(docs, language.fit_on(docs))


def p8_report(spark, sf_dir):
    return language.report(table(spark, sf_dir, "documents"))


QUERIES = {name: call for name, call in list(globals().items()) if name[:1] == "p" and name[1:2].isdigit()}

_FOLD = r"trim(regexp_replace(lower(nfc_normalize({c})), '\s+', ' ', 'g'))"
_NOBODY = ", ".join(f"'{x}'" for x in splits.NOBODY)
SQL = {
    "p3_found": f"""
with recursive own as (
  select text_id, {_FOLD.format(c="author")} as author, {_FOLD.format(c="source_name")} as source from texts where text_id is not null),
bound as (
  select 'a' as kind, author as value, text_id from own
  where regexp_replace(strip_accents(author), '[^\\p{{L}}\\p{{N}}]+', '', 'g') not in ('', {_NOBODY})
  union select 's', source, text_id from own where source <> ''
  union select 'f', regexp_replace(lower(trim(hash)), '^sha256:', ''), text_id from families
  where trim(hash) <> '' and text_id in (select text_id from own)),
star as (select distinct text_id as u, min(text_id) over (partition by kind, value) as v from bound),
edge as (select u, v from star where u <> v union select v, u from star where u <> v),
reach(a, b) as (select u, u from edge union select r.a, e.v from reach r join edge e on r.b = e.u)
select a as text_id, min(b) as group_id from reach group by a""",
    "p6_roundtrip": "select source, count(*) as docs, count(*) as exact from documents group by source",
}
