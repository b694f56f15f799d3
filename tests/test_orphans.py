"""The reference check: bitmaps against sets, every cause, and dirty input."""

import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators.bitmap import Bitmap
from quern.operators.orphans import orphan_report, orphans

TASK = "id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"
CHILD = "id string, task_id string, created_at timestamp_ntz, ingested_at timestamp_ntz"


def key(n):
    return f"{n:08x}-0000-4000-8000-000000000000"


def day(n):
    return datetime(2025, 1, n)


@given(st.sets(st.integers(0, 200_000)), st.sets(st.integers(0, 200_000)))
@settings(max_examples=60, deadline=None)
def test_bitmap_is_a_set(a, b):
    x, y = Bitmap.of(np.array(sorted(a), dtype=np.int64)), Bitmap.of(np.array(sorted(b), dtype=np.int64))
    assert set(x.and_not(y).decode().tolist()) == a - b
    assert set(x.union(y).decode().tolist()) == a | b
    assert len(x) == len(a)


def test_dense_bitmap():
    rng = random.Random(1)
    a, b = {rng.randrange(140_000) for _ in range(60_000)}, {rng.randrange(140_000) for _ in range(90_000)}
    x, y = Bitmap.of(np.array(list(a))), Bitmap.of(np.array(list(b)))
    assert set(x.and_not(y).decode().tolist()) == a - b
    assert set(y.and_not(Bitmap.of(np.array(list(a))[:100])).decode().tolist()) == b - set(list(a)[:100])
    assert x.nbytes() < 8 * len(a)


def rows(spark, tasks, events, runs=()):
    out = orphans(spark.createDataFrame(tasks, TASK), {"task_events": spark.createDataFrame(events, CHILD), "inference_runs": spark.createDataFrame(list(runs), CHILD)})
    return {(r["child_table"], r["id"]): r["cause"] for r in out.collect()}


def test_causes_and_spellings(spark):
    tasks = [(key(1), day(5), None), (key(2), day(5), None), (key(2), day(9), day(9)), (key(3), day(5), day(5)), (key(3), day(9), None), (key(4).upper(), day(20), None)]
    spelt = ["  " + key(1), "{" + key(1) + "}", "urn:uuid:" + key(1), key(1).replace("-", "").upper() + " "]
    events = [(f"e{i}", k, day(6), day(6)) for i, k in enumerate(spelt)]
    events += [("gone", key(2), day(6), day(6)), ("back", key(3), day(6), day(6)), ("none", key(9), day(6), day(6)), ("short", key(1)[:8], day(6), day(6)), ("late", key(4), day(6), day(6)), ("in time", key(4), day(20), day(20))]
    found = rows(spark, tasks, events, [("late", key(4), day(6), day(21))])
    assert found == {("task_events", "gone"): "deleted", ("task_events", "none"): "missing", ("task_events", "short"): "missing", ("task_events", "late"): "late"}


def test_no_reference_and_redelivery(spark):
    nothing = [None, "", "   ", "{}", "00000000-0000-0000-0000-000000000000", "\t"]
    events = [(f"n{i}", k, day(6), day(6)) for i, k in enumerate(nothing)]
    events += [("twice", key(7), None, day(9)), ("twice", key(7), None, day(3)), ("twice", key(7), None, day(3)), (None, key(8), day(1), day(1)), ("null time", key(7), day(1), None)]
    assert rows(spark, [(key(7), day(5), None)], events) == {("task_events", "twice"): "late"}


@pytest.mark.parametrize("tasks", [[], [(None, None, None)]])
def test_empty_tables(spark, tasks):
    assert rows(spark, tasks, []) == {}
    assert rows(spark, tasks, [("a", key(1), None, None)]) == {("task_events", "a"): "missing"}


def test_hot_key_and_clashing_columns(spark):
    parent = spark.createDataFrame([(key(1), day(5), None, "x")], TASK + ", month string")
    child = spark.range(5000).selectExpr("concat('e', id) as id", f"if(id % 3 = 0, '{key(2)}', '{key(1)}') as task_id", "timestamp_ntz'2025-01-06' as created_at", "timestamp_ntz'2025-01-06' as ingested_at", "'k' as key", "1 as us", "2 as range")
    found = orphans(parent, {"t": child}, range_rows=100)
    assert found.count() == 1667
    assert [tuple(r) for r in orphan_report(found).collect()] == [("t", "2025-01", "missing", 1667)]


def test_random_against_brute_force(spark):
    rng = random.Random(4)
    tasks = [(key(rng.randrange(30)), day(rng.randrange(1, 28)), rng.choice([None, None, day(1)])) for _ in range(50)]
    events = [(f"e{i}", rng.choice([key(rng.randrange(45)), None, key(rng.randrange(45)).upper()]), day(rng.randrange(1, 28)), day(rng.randrange(1, 28))) for i in range(300)]
    by = {}
    for k, t, gone in tasks:
        by.setdefault(k, []).append((t, gone is not None))
    want = {}
    for i, k, _, t in events:
        if k is None:
            continue
        own = by.get(k.lower())
        cause = "missing" if own is None else "deleted" if max(own)[1] else "late" if t < min(own)[0] else None
        if cause:
            want["task_events", i] = cause
    assert rows(spark, tasks, events) == want
