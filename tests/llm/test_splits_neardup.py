"""Groups against union-find, splits against their shares, overlaps against the edit distance of all pairs."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import neardup, splits

TEXTS = "text_id long, author string, source_name string, group_id string, kind string"
FAMILIES = "text_id long, hash string, split string"


def found(spark, texts, families):
    t = spark.createDataFrame([(i, a, s, "x", "y") for i, a, s in texts], TEXTS)
    return {r["text_id"]: r["group_id"] for r in splits.groups(t, spark.createDataFrame([(*f, "train") for f in families], FAMILIES)).collect()}


def test_bindings_and_what_binds_nothing(spark):
    h = "ab" * 32
    texts = [(1, "Ana  Ruiz", None), (2, " ana ruiz ", "S1"), (3, None, unicodedata.normalize("NFD", "s1")), (4, "Unknown", ""), (5, "unknown", "  "), (6, "—", None), (7, "N. N.", None), (8, "n.n.", None), (9, "Anònim", "Única"), (10, "anónimo", unicodedata.normalize("NFD", "ÚNICA")), (11, None, None), (12, "Ana Ruiz2", None)]
    families = [(11, f"sha256:{h}"), (12, f" {h.upper()} "), (4, ""), (5, ""), (6, None), (7, "  "), (99, h), (None, h)]
    assert found(spark, texts, families) == {1: 1, 2: 1, 3: 1, 9: 9, 10: 9, 11: 11, 12: 11}


def test_empty_and_repeated_rows(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "a b", None), (1, "a b", None), (None, "a b", None)], [(1, "f"), (1, "f")]) == {}


def test_random_graphs_against_union_find(spark):
    rng = random.Random(3)
    texts = [(i, f"author {rng.randrange(60)}" if rng.random() < 0.6 else None, f"source {rng.randrange(60)}" if rng.random() < 0.5 else None) for i in range(150)]
    families = [(rng.randrange(150), f"{rng.randrange(80):064x}") for _ in range(90)]
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for key, i in [(("a", a), i) for i, a, _ in texts if a] + [(("s", s), i) for i, _, s in texts if s] + [(("f", h), i) for i, h in families]:
        j = by.setdefault(key, i)
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    size = Counter(map(root, range(150)))
    assert found(spark, texts, families) == {i: root(i) for i in range(150) if size[root(i)] > 1}


def test_long_chain_and_hot_value(spark):
    chain = [(i, f"w{i // 2} x", f"v{(i + 1) // 2} x") for i in range(64)]
    hot = [(1000 + i, "one author", None) for i in range(500)]
    got = found(spark, chain + hot, [])
    assert {got[i] for i in range(64)} == {0} and {got[1000 + i] for i in range(500)} == {1000}


def test_assigned_splits(spark):
    rng = random.Random(4)
    texts = spark.createDataFrame([(i, f"a{rng.randrange(900)} b", None, "x", "y") for i in range(2000)] + [(5000 + i, "giant one", None, "x", "y") for i in range(1000)], TEXTS)
    families = spark.createDataFrame([], FAMILIES)
    out = splits.assign(texts, families).cache()
    assert out.groupBy("group_id").agg({"split": "count"}).count() == out.select("group_id", "split").distinct().count()
    shares = {r["split"]: r["actual_share"] for r in splits.shares(out).collect()}
    assert abs(shares["train"] - 0.8) < 0.05 and abs(shares["test"] - 0.1) < 0.04
    again = splits.assign(texts, families)
    assert out.exceptAll(again).count() == 0
    assert splits.assign(texts.limit(0), families).count() == 0


def test_weights_of_sizes():
    rng = random.Random(9)
    draws = lambda: {s: rng.random() for s in splits.WEIGHTS}
    sizes = [(40_000, 1, draws()), (30_000, 1, draws()), (9_000, 1, draws()), (700, 5, draws()), (3, 4000, draws()), (1, 5500, draws())]
    by_size = splits.size_weights(sizes, splits.WEIGHTS)
    assert set(by_size[40_000]) == {"train"} and set(by_size[30_000]) == {"train"} and len(by_size[1]) >= 2
    placed = dict.fromkeys(splits.WEIGHTS, 0)
    for n, count, own in sizes:
        for i in range(count):
            placed[splits._chosen(by_size[n], own if count == 1 else draws())] += n
    total = sum(placed.values())
    assert abs(placed["train"] / total - 0.8) < 0.02 and abs(placed["test"] / total - 0.1) < 0.02


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    assert neardup.edit_distance(a, b) == row[-1]


COLUMNS = "text_id long, split string, source_name string, text string, cls string, norm string, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, "src", t, "c", "n", "h") for i, s, t in rows], COLUMNS)


def pairs(spark, rows):
    return {(r["id_a"], r["id_b"]) for r in neardup.found(frame(spark, rows)).collect()}


def test_exact_up_to_form(spark):
    t = "The Café is open; until nine o'clock tonight"
    rows = [(1, "train", t), (2, " TEST ", unicodedata.normalize("NFD", t.upper()).replace(" ", "  ")), (3, "dev", t.replace(";", " -")), (4, None, t), (5, "unassigned", t), (6, "", t), (7, "Train", t), (8, "test", None), (9, "test", ""), (10, "train", "..."), (11, "test", "!!"), (None, "test", t)]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 7), (3, 7)}


def test_short_texts_and_limit(spark):
    rows = [(1, "train", "one two three four"), (2, "test", "one two three five"), (3, "test", "one two six five"), (4, "train", "word"), (5, "test", "word"), (6, "dev", "other")]
    got = pairs(spark, rows)
    assert (4, 5) in got and (1, 3) not in got and all(6 not in p for p in got)


def test_against_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(60):
        if i and rng.random() < 0.6:
            w = list(rng.choice(texts))
            for _ in range(rng.randrange(0, max(1, len(w) // 9))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], rng.choice(vocabulary)]])
        else:
            w = rng.choices(vocabulary, k=rng.randrange(40, 120))
        texts.append(w)
        rows.append((i, rng.choice(["train", "train", "test", "dev"]), " ".join(w)))
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (rows[a][1] == "train") != (rows[b][1] == "train") and neardup.edit_distance(texts[a], texts[b]) <= 0.25 * max(len(texts[a]), len(texts[b]))}
    got = pairs(spark, rows)
    near = {p for p in want if neardup.edit_distance(texts[p[0]], texts[p[1]]) <= 0.15 * max(len(texts[p[0]]), len(texts[p[1]]))}
    assert got <= want and len(near - got) <= 0.01 * len(near) and len(near) > 20 and len(got) >= 0.95 * len(want)


def test_copies_report_and_empty(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(i, "train", long) for i in range(30)] + [(100 + i, "test", long + " end") for i in range(4)]
    assert len(pairs(spark, rows)) == 120
    r = neardup.report(frame(spark, rows)).head()
    assert (r["split"], r["pairs"], r["texts"], r["exact"]) == ("test", 120, 4, 0)
    assert pairs(spark, []) == set() and pairs(spark, rows[:30]) == set()


def test_recall_at_the_limit_against_all_pairs(spark):
    """A quarter of the words of each text replaced, dropped or added, in places or as a block."""
    rng = random.Random(17)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows, texts = [], {}
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(12, 140))]
        n = int(0.25 * len(w) * rng.choice([1.0, 1.0, 0.8, 0.6]))
        edited = list(w)
        if rng.random() < 0.2:
            k = rng.randrange(len(w) - n)
            edited[k : k + n] = []
        else:
            for k in sorted(rng.sample(range(len(w)), n), reverse=True):
                edited[k : k + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [f"x{rng.randrange(10**6)}"], [f"x{rng.randrange(10**6)}"]])
        texts |= {2 * i: w, 2 * i + 1: edited}
        rows += [(2 * i, "train", " ".join(w)), (2 * i + 1, "test", " ".join(edited))]
    want = {(min(a, b), max(a, b)) for a in range(0, 300, 2) for b in range(1, 300, 2) if neardup.edit_distance(texts[a], texts[b]) <= 0.25 * max(len(texts[a]), len(texts[b]))}
    got = pairs(spark, rows)
    assert got <= want and len(want) >= 140 and len(got) >= 0.95 * len(want)


def test_counts_by_class_equal_counted_pairs(spark):
    rng = random.Random(23)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(6)]
    rows = [(rng.randrange(60), rng.choice(["train", "train", "test", "dev"]), t if rng.random() < 0.5 else t + " end") for t in base for _ in range(14)]
    rows = rows + rows[:5]
    df = frame(spark, rows)
    over = [tuple(r) for r in neardup.overlaps(df).select("train_id", "other_id", "split", "source", "jaccard").collect()]
    want = {}
    for a, b, split, source, j in set(over):
        n = want.setdefault((split, source), [[], set(), set()])
        n[0].append((a, b))
        n[1].add(b)
        if j == 1:
            n[2].add(b)
    got = {(r["split"], r["source"]): (r["texts"], r["exact"]) for r in neardup.report(df).collect()}
    assert got == {k: (len(b), len(c)) for k, (_, b, c) in want.items()}
    assert sum(r["pairs"] for r in neardup.report(df).collect()) == len(over)
    linked = {(r["text_id"], r["split"]): r for r in neardup.classes(frame(spark, [(i, s, t) for i, (_, s, t) in enumerate(rows)])).collect()}
    plain = pairs(spark, [(i, s, t) for i, (_, s, t) in enumerate(rows)])
    degree = Counter(x for p in plain for x in p)
    assert {i: r["links"] for (i, _), r in linked.items()} == {i: degree[i] for i in range(len(rows))}
    assert all(rows[i][2] == rows[r["class_id"]][2] for (i, _), r in linked.items())


def test_equal_bytes(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 4, (50, 8), dtype=np.uint8)
    b = rng.integers(0, 4, (50, 8), dtype=np.uint8) * rng.choice([1, 85], (50, 8)).astype(np.uint8)
    rows = list(zip(a.view(np.int64).ravel().tolist(), b.view(np.int64).ravel().tolist()))
    got = spark.createDataFrame(rows, "a long, b long").select(neardup.equal_bytes(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == (a == b).sum(axis=1).tolist()


def test_jaccard_counts_occurrences():
    a, b = "a a b c".split(), "a b b d".split()
    assert neardup.jaccard(neardup.occurrences(a), neardup.occurrences(b)) == 2 / 6


@pytest.mark.parametrize("value,want", [(" Train ", "train"), ("unassigned", None), ("", None), (None, None), ("DEV", "dev")])
def test_split_names(value, want):
    assert neardup.split_name(value) == want


def test_bins_drop_no_pair_within_the_limit(spark):
    from quern.functions import minwise

    rng = random.Random(31)
    pairs = []
    for i in range(600):
        n = rng.choice((1, 4, 30, 120, 700))
        vocabulary = rng.choice((2, 50, 400))
        a = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
        b = list(a) if i % 3 else [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
        for _ in range(rng.randrange(1 + n // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.choice((0, 1))] = [f"x{rng.randrange(300)}"] * rng.choice((0, 1))
        pairs.append((a, b or ["z"]))
    counts = [neardup.binned(*minwise.flat([p[k] for p in pairs], minwise.WordHashes())) for k in (0, 1)]
    rows = [(i, i, len(a), len(b), bytearray(x.tobytes()), bytearray(y.tobytes())) for i, ((a, b), x, y) in enumerate(zip(pairs, *counts))]
    kept = {r["a"] for r in neardup._by_bins(spark.createDataFrame(rows, "a long, b long, n_a int, n_b int, bins_a binary, bins_b binary"), 0.25).collect()}
    near = {i for i, (a, b) in enumerate(pairs) if neardup.edit_distance(a, b) <= 0.25 * max(len(a), len(b))}
    assert near <= kept and 100 < len(near) and len(kept - near) < 0.5 * (len(pairs) - len(near))
