"""From raw documents to a released corpus: one funnel, shards of each split, and a manifest of what went where."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.dedup import funnel
from quern.session import spill
from quern.sources import files


def build(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", evaluation: DataFrame | None = None, holdout: int = 2, docs_per_shard: int = files.DOCS_PER_SHARD, formulaic: str | None = None) -> DataFrame:
    """Writes the kept documents as gzip JSONL shards under out and returns (split, reason, n): every document counts once.

    The outcome is written once and read twice (for the shards and the counts); texts are joined back only for the kept ones.
    An existing release is never overwritten."""
    outcome, _ = spill(funnel(docs, key, text, evaluation, holdout, formulaic), "outcome")
    kept = docs.join(outcome.where("reason is null").select(key, "split"), key).withColumn("sha256", F.sha2(text, 256))
    for split in ("train", "validation"):
        files.write_shards(kept.where(F.col("split") == split).drop("split"), out, split, docs_per_shard)
    return outcome.groupBy("split", "reason").agg(F.count("*").alias("n"))
