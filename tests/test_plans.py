"""The corpus build end to end."""

import random

import pytest

from quern.plans.corpus_build import build
from quern.sources import files


def test_build_writes_every_kept_document_once(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=90))) for i in range(60)] + [(100, "short"), (101, None)]
    docs += [(200, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = build(df, str(tmp_path / "out"), holdout=20).collect()
    assert sum(r["n"] for r in counts) == len(docs)
    kept = {s: files.read_shards(spark, str(tmp_path / "out"), s, "doc_id long, text string, sha256 string").count() for s in ("train", "validation")}
    assert kept == {r["split"]: r["n"] for r in counts if r["reason"] is None} and sum(kept.values()) == 60
    assert {(r["reason"], r["n"]) for r in counts if r["reason"]} == {("too_short", 2), ("duplicate", 1)}
    with pytest.raises(Exception, match="(?i)exist"):
        build(df, str(tmp_path / "out"), holdout=20)
