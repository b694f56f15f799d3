"""General operators on small frames: hand-made results, boundaries, empty input, slow models in Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.functions import html, stats
from quern.functions import text as tx
from quern.functions.hashing import canonical_json, hash_bucket, simhash64
from quern.operators import aggregates, components, decisions, dedup, joins, records, windows
from quern.operators.merkle import merkle_root
from quern.operators.topk import cosine_topk


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).head()["v"]


def test_wilson_without_observations(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    assert tuple(spark.createDataFrame([(0, 0)], "k int, n int").select(low, high).head()) == (0.0, 1.0)


def test_tier_boundaries(spark):
    df = spark.createDataFrame([(0.92, True), (0.921, True), (0.95, False), (0.8, True), (0.6, True), (0.59, True)], "s double, p boolean")
    assert [r[0] for r in df.select(stats.tier(F.col("s"), F.col("p"))).collect()] == ["silver", "gold", "silver", "silver", "bronze", "raw"]


def test_percentiles_differ(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "g string, x double")
    assert aggregates.percentile_nearest(df, ["g"], "x", {"p": 0.5}).head()["p"] == 2.0
    assert aggregates.percentile_linear(df, ["g"], "x", {"p": 0.5}).head()["p"] == 2.5
    assert aggregates.percentile_index(df, ["g"], "x", 0.5, "p").head()["p"] == 3.0  # round(1.5) is 2


def test_histogram_edge_is_inclusive(spark):
    df = spark.createDataFrame([("a", 50.0), ("a", 50.1), ("a", 999.0)], "g string, x double")
    got = {r["le"]: r["cumulative"] for r in aggregates.histogram(df, ["g"], "x", [50, 100]).collect()}
    assert got == {50.0: 1, 100.0: 2, None: 3}


def test_ema_is_the_fold(spark):
    xs = [0.3, 0.9, 0.1, 0.7]
    s = 0.5
    for x in xs:
        s = 0.95 * s + 0.05 * x
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(xs)], "m string, i int, x double")
    assert windows.ema(df, ["m"], F.col("i"), "x", 0.05, 0.5).head()["ema"] == pytest.approx(s)


def test_chain_finds_one_flipped_byte_and_a_gap(spark):
    df = spark.createDataFrame([("s", i, f"b{i}") for i in range(6)], "s string, i int, b string")
    good = windows.chain(df, "s", [F.col("i")], F.col("b"))
    assert windows.verify_chain(good, "s").head()["broken_seq"] is None
    assert tuple(windows.verify_chain(good.withColumn("body", F.when(F.col("seq") == 4, "b9").otherwise(F.col("body"))), "s").select("broken_seq", "broken_why").head()) == (4, "body")
    assert windows.verify_chain(good.where("seq <> 3"), "s").head()["broken_why"] == "gap"


def test_as_of_and_interval(spark):
    t = datetime(2025, 1, 1)
    left = spark.createDataFrame([(1, "u", t + timedelta(hours=h)) for h in (0, 2, 5)], "n int, u string, ts timestamp_ntz")
    right = spark.createDataFrame([("u", t + timedelta(hours=1), "a"), ("u", t + timedelta(hours=4), "b")], "u string, ts timestamp_ntz, v string")
    assert [r["v"] for r in joins.as_of_join(left, right, "u", "ts", "ts", ["v"]).orderBy("ts").collect()] == [None, "a", "b"]
    spans = spark.createDataFrame([("u", t, t + timedelta(hours=2), "x"), ("u", t + timedelta(hours=3), None, "y")], "u string, valid_from timestamp_ntz, valid_until timestamp_ntz, state string")
    assert [r["state"] for r in joins.interval_join(left, spans, "u", "ts").orderBy("ts").collect()] == ["x", "y"]


def test_hamming_pairs_against_brute_force(spark):
    rng = random.Random(2)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    codes += [c ^ (1 << rng.randrange(62)) for c in codes[:10]] + codes[:3]
    df = spark.createDataFrame(list(enumerate(codes)), "k long, c long")
    first = {c: min(i for i, x in enumerate(codes) if x == c) for c in codes}
    want = {(a, b) for a in first.values() for b in first.values() if a < b and bin((codes[a] ^ codes[b]) & (2**64 - 1)).count("1") <= 3}
    assert {(r["a"], r["b"]) for r in joins.hamming_pairs(df, "k", "c", 3).collect()} == want


def test_pareto_against_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.randrange(20), rng.randrange(20)) for i in range(80)]
    want = {i for i, x, y in pts if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in pts)}
    df = spark.createDataFrame(pts, "k int, x int, y int")
    assert {r["k"] for r in joins.pareto(df, "k", ["x", "y"]).collect()} == want


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (5, 0)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert {roots[i] for i in range(21)} == {0} and {roots[i] for i in (100, 101, 102)} == {100}
    reach = {r["node"]: r["depth"] for r in components.reachable(edges, spark.createDataFrame([(3,)], "node long")).collect()}
    assert reach[0] == 3 and reach[20] == 17 and 100 not in reach
    empty = spark.createDataFrame([], "u long, v long")
    assert components.components(empty).count() == 0


def test_greedy_keep_is_the_first_independent_set(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    kept = set()
    for n in range(60):
        if not any((a, n) in set(edges) and a in kept for a in range(n)):
            kept.add(n)
    got = dedup.greedy_keep(spark.range(60).toDF("id"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"] for r in got.where("kept").collect()} == kept and got.count() == 60


def test_funnel_gives_each_document_one_outcome(spark):
    rng = random.Random(6)
    vocabulary = ["river", "stone", "paper", "garden", "window", "market", "silver", "letter", "evening", "village", "harvest", "morning"]

    def words(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = [words(120) for _ in range(6)]
    near = base[0].split()
    near[-1] = "changed"
    texts = [*base, base[1], " ".join(near), " ".join(near), "short", None, "# " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {r["id"]: r["reason"] for r in dedup.funnel(df, "id", "text", spark.createDataFrame([(0, base[5])], "id long, text string")).collect()}
    assert len(out) == len(texts)
    assert out[0] is None and out[6] == "duplicate" and out[7] == out[8] == "near_duplicate" and out[5] == "contaminated" and out[9] == out[10] == "too_short"


def test_line_duplicates(spark):
    assert sorted(one(spark, tx.duplicates(tx.lines(F.col("t"))), "t string", ("a\nb\n a \n\nc\nb\nb",))) == ["a", "a", "b", "b", "b"]
    assert one(spark, tx.duplicates(tx.lines(F.col("t"))), "t string", (None,)) == []


def test_ngram_repetition(spark):
    df = spark.createDataFrame([("a b " * 30,), (" ".join(f"w{i}" for i in range(100)),), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.ngram_repetition("t")).collect()]
    assert got[0][0] > 0.9 and got[0][3] == 1.0 and set(got[1]) == set(got[2]) == set(got[3]) == {0.0}


def test_simhash_and_hash_helpers(spark):
    assert one(spark, simhash64(F.array(F.lit("a"))), "x int", (1,)) == one(spark, F.xxhash64(F.lit("a")), "x int", (1,))
    assert one(spark, simhash64(F.array().cast("array<string>")), "x int", (1,)) is None
    assert one(spark, hash_bucket(F.lit("a"), 100)) == int("ca978112", 16) % 100
    assert one(spark, canonical_json(F.lit('{"b":1, "a":[1, 2]}'))) == '{"a":[1,2],"b":1}'


def test_merkle_doubles_the_last(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    a, b, c = h("a"), h("b"), h("c")
    df = spark.createDataFrame([("s", 0, a), ("s", 1, b), ("s", 2, c), ("t", 0, a)], "s string, pos long, leaf string")
    roots = dict(map(tuple, merkle_root(df, "s", "pos", "leaf").collect()))
    assert roots == {"s": h(h(a + b) + h(c + c)), "t": a}


def test_quota_and_cap(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 100 + i) for i in range(4)], "g string, i int")
    assert Counter(r["g"] for r in records.quota(df, "g", {"a": 0.5, "b": 0.5}, "i").collect()) == {"a": 4, "b": 4}
    with pytest.raises(ValueError):
        records.quota(df, "g", {"a": 0.5, "z": 0.5}, "i")
    assert records.synthetic_cap(df, F.col("g") == "b", 0.2, "i").where("g = 'b'").count() == 2


def test_topk_against_all(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, None), (61, [0.0] * 6), (62, [1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = cosine_topk(df.where("k % 20 = 0 and k < 60"), df, "k", "v", 3, block=2)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in (0, 20, 40):
        best = sorted(((-cos(rows[q][1], v), i) for i, v in rows[:60] if i != q))[:3]
        assert [r["k"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == [i for _, i in best]


def test_html_page():
    assert html.page("<head><title>t</title></head><p>A&amp;B <b>c</b></p><script>x</script><nav>n</nav><a href='/l'>go</a>") == ("A&B c\ngo", ["/l"])
    assert html.page("") == ("", []) and html.page(None) == (None, [])


def test_document_forms():
    from quern.functions import documents as d

    assert d.repair_scan("The zones inun-\ndables are\nclosed.\nNext one.") == "The zones inundables are closed.\nNext one."
    assert d.chunks("a b " * 30 + "\n\n" + "c", 50)[0].startswith("a b") and all(len(x) <= 50 for x in d.chunks("word " * 100, 50)) and d.chunks("") == []
    assert d.code_reason("") == "empty" and d.code_reason("def f(:") == "syntax" and d.code_reason("x = 1\n") is None
    assert d.structure_hash("def f(a):\n    '''doc'''\n    return a + 'x'") == d.structure_hash("def g(b):\n    return b + 'y'") != d.structure_hash("def g(b):\n    return b - 'y'")
    assert ("calls", "f", "g") in d.code_edges("import os\ndef f():\n    g()") and d.code_edges("def") == []
    assert d.lcs(list("abcde"), list("xbxdx")) == 2 and d.lcs([], [1]) == 0
    assert d.same_json("1", "1.0") and not d.same_json("1", "true") and not d.same_json(None, "1") and d.same_json('{"a":[1]}', '{ "a": [1.0] }')
    assert abs(sum(x * x for x in d.embed("two words")) - 1) < 1e-9 and set(d.embed("")) == {0.0}


def test_plans_and_cycles(spark):
    from quern.operators import decisions

    rows = [(1, 1, 2.0, []), (1, 2, 3.0, [1]), (1, 3, 1.0, [1]), (2, 1, 1.0, [2]), (2, 2, 1.0, [1])]
    got = {r["plan"]: (r["critical"], r["cyclic"]) for r in decisions.critical_paths(spark.createDataFrame(rows, "plan long, node long, cost double, depends array<long>")).collect()}
    assert got[1] == (5.0, False) and got[2][1] is True


def test_gate_counts_what_is_missing(spark):
    from quern.operators import decisions

    rows = [("a", "q", 0.9, None), ("a", "l", 10.0, None), ("a", "ok", None, True), ("b", "q", float("nan"), None), ("b", "ok", None, None)]
    got = {r["key"]: r["failures"] for r in decisions.gate(spark.createDataFrame(rows, "key string, metric string, number double, flag boolean"), {"q": 0.5}, {"l": 20.0}, ["ok"]).collect()}
    assert got == {"a": [], "b": ["q", "l", "ok"]}


def test_temperature_finds_the_scale(spark):
    from quern.operators import decisions

    rng = random.Random(11)
    rows = []
    for _ in range(4000):
        z = rng.gauss(0, 2)
        rows.append((3 * z, rng.random() < 1 / (1 + 2.718281828 ** -z)))
    t = decisions.temperature(spark.createDataFrame(rows, "z double, y boolean"), "z", "y").head()["temperature"]
    assert 2.3 < t < 3.8


def _mined(spark, traces, support=3, least=0.7):
    rows = [(t, i, k) for t, (steps, _) in enumerate(traces) for i, k in enumerate(steps)]
    events = spark.createDataFrame(rows, "task long, i int, kind string")
    good = spark.createDataFrame([(t, ok) for t, (_, ok) in enumerate(traces)], "task long, good boolean")
    return sorted(tuple(r) for r in decisions.mine_sequences(events, "task", "kind", ["i"], good, support, least).collect())


def test_long_sequences_are_mined(spark):
    long = ["a", "b"] * 150
    assert _mined(spark, [(long, True)] * 3 + [(["b", "a"] * 150, True)] + [(["a", "b"], True)] * 2) == [(">".join(long), 3, 1.0)]


def test_without_support_the_common_subsequence_is_mined(spark):
    traces = [(list("axbc"), True), (list("aybc"), True), (list("abzc"), True), (list("q"), False)]
    assert _mined(spark, traces) == [("a>b>c", 3, 0.75)]
    assert _mined(spark, traces, least=0.8) == []
    assert _mined(spark, [(list("ab"), True), (list("ba"), True), (list("cab"), True)]) == []
    assert _mined(spark, [(list("ab"), True)] * 3 + traces) == [("a>b", 3, 1.0)]


def test_hamming_members_and_guard_against_brute_force(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(30)]
    codes += [c ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for c in codes[:10]] + codes[5:15] + codes[5:8]
    apart = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    df = spark.createDataFrame(list(enumerate(codes)), "k long, c long")
    first = {c: min(i for i, x in enumerate(codes) if x == c) for c in codes}
    got = joins.hamming_pairs(df, "k", "c", 3, members=True)
    assert {(r["a"], r["b"]) for r in got.where("distance = 0").collect()} == {(first[c], i) for i, c in enumerate(codes) if first[c] != i}
    assert {tuple(r) for r in got.where("distance > 0").collect()} == {tuple(r) for r in joins.hamming_pairs(df, "k", "c", 3).collect()}
    held = [i for i in range(len(codes)) if i % 3 == 0]
    want = {}
    for i, c in enumerate(codes):
        near = min((apart(c, codes[j]), j) for j in held)
        if i % 3 and near[0] <= 6:
            want[i] = near[::-1]
    assert any(x[1] == 0 for x in want.values()) and any(x[1] > 0 for x in want.values())
    assert {r["k"]: (r["near"], r["distance"]) for r in joins.hamming_guard(df.where("k % 3 <> 0"), df.where("k % 3 = 0"), "k", "c", 6).collect()} == want


def test_copies_of_evaluation_texts_are_guarded(spark, tmp_path):
    import __spark_entry__ as entry

    copied, other = "one two three four five six seven", "quite another text about nothing at all"
    rows = [(1, "Train ", copied), (2, "TEST", copied), (3, "train", other), (4, "train", "Hello, reader"), (5, "dev", "hello reader"), (6, "train", "Yes"), (7, "dev", "yes"), (8, None, copied)]
    spark.createDataFrame(rows, "text_id long, split string, text string").write.parquet(str(tmp_path / "texts.parquet"))
    assert sorted(tuple(r) for r in entry.queries()["c4_simhash_guard"](spark, str(tmp_path)).collect()) == [(1, 2, 0), (4, 5, 0)]
    pairs = {(r["a"], r["b"], r["distance"]) for r in entry.queries()["j5_simhash_pairs"](spark, str(tmp_path)).collect()}
    assert pairs == {(1, 2, 0), (1, 8, 0), (4, 5, 0), (6, 7, 0)}


def test_documents_without_source_are_checked(spark, tmp_path):
    import __spark_entry__ as entry

    words = " ".join(f"w{i}" for i in range(15))
    rows = [(1, None, f"lead {words} end"), (2, "Seed prompts", words), (3, "other", "nothing " * 20), (4, "other", words)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r[0] for r in entry.queries()["j4_contaminated"](spark, str(tmp_path)).collect()) == [1, 4]


def test_funnel_drops_repeated_phrases_but_for_formulaic_texts(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    repeated = " ".join(words[:20] * 8)
    df = spark.createDataFrame([(0, repeated, False), (1, repeated + " more", True), (2, " ".join(words), False)], "id long, text string, law boolean")
    out = {r["id"]: r["reason"] for r in dedup.funnel(df, "id", "text", formulaic="law").collect()}
    assert out[0].endswith("gram") and out[1] is None and out[2] is None
    plain = {r["id"]: r["reason"] for r in dedup.funnel(df, "id", "text").collect()}
    assert plain[0] == plain[1] == out[0] and plain[2] is None


def test_queries_see_whole_tables(spark, tmp_path):
    import hashlib

    import __spark_entry__ as entry

    rng = random.Random(8)
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    spark.createDataFrame([(i,) for i in range(1, 401)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    edges = {(u, (u * 7 + 3) % 401) for u in range(1, 401)}
    edges |= {(v, u) for u, v in edges}
    depth, front = {1: 0}, {1}
    while front:
        front = {v for u, v in edges if u in front} - set(depth)
        depth |= dict.fromkeys(front, max(depth.values()) + 1)
    assert {tuple(r) for r in run("u8_shortest_paths_all")} == set(depth.items())
    assert {tuple(r) for r in run("j9_neighbours_all")} == {x for x in depth.items() if x[1] <= 2}
    spark.createDataFrame([(995 + i, "O", f"p{i}") for i in range(9)], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    level = [hashlib.sha256(f"p{i}".encode()).hexdigest() for i in range(9)]
    while len(level) > 1:
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], [*level[1::2], level[-1]])]
    assert [tuple(r) for r in run("h2_merkle")] == [("O", level[0])]
    spark.createDataFrame([(k, n, float(k + n)) for k in (299, 300, 5000) for n in (1, 2, 3, 4)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {(r["plan"], r["critical"]) for r in run("h10_critical_path")} == {(k, 3 * k + 7.0) for k in (299, 300, 5000)}
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(160)]
    spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    asked = [0, 50, 100, 150]
    ranked = {q: sorted((-(0.55 * cos(v, vectors[q]) + 0.015 * (i % 5) + 0.1 / (1 + i % 90 / 30)), i) for i, v in enumerate(vectors) if cos(v, vectors[q]) >= 0.15)[:10] for q in asked}
    assert {(r["query_id"], r["vec_id"]) for r in run("k2_rerank")} == {(q, i) for q in asked for _, i in ranked[q]}
    assert {(r["key"], r["answer"]) for r in run("c29_cache_lookup_all")} == {(f"q{q}", f"a{q}") for q in asked}


def test_pareto_of_three_measures(spark):
    rng = random.Random(12)
    rows = [(i, rng.randrange(12), rng.randrange(12), rng.randrange(12)) for i in range(400)] + [(900, None, 50, 50)]
    df = spark.createDataFrame(rows, "k long, x long, y long, z long")
    full = [r for r in rows if None not in r]
    want = {r[0] for r in full if not any(all(b >= a for a, b in zip(r[1:], s[1:])) and s[1:] != r[1:] for s in full)}
    assert {r["k"] for r in joins.pareto(df, "k", ["x", "y", "z"]).collect()} == want
    assert joins.pareto(df.limit(0), "k", ["x", "y", "z"]).count() == 0


@pytest.mark.parametrize("distance", [1, 3, 6])
def test_hamming_pairs_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    codes = []
    for _ in range(60):
        c = rng.getrandbits(64)
        codes += [c]
        for _ in range(rng.randrange(3)):
            for bit in rng.sample(range(64), rng.randrange(distance + 3)):
                c ^= 1 << bit
            codes.append(c)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "k long, c long")
    rep = {}
    for i, c in enumerate(codes):
        rep.setdefault(c, i)
    want = {(min(i, j), max(i, j)) for a, i in rep.items() for b, j in rep.items() if i != j and (a ^ b).bit_count() <= distance}
    assert {(r["a"], r["b"]) for r in joins.hamming_pairs(df, "k", "c", distance).collect()} == want


def test_simhash_takes_the_majority():
    import numpy as np
    import pandas as pd

    from quern.functions.hashing import majority, simhash_of_text

    rng = random.Random(4)
    arrays = [[rng.getrandbits(64) for _ in range(n)] for n in (1, 2, 3, 8, 9)]
    got = majority(np.array(sum(arrays, []), dtype=np.uint64), np.array([len(a) for a in arrays]))
    for own, code in zip(arrays, got):
        assert int(code) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in own) > len(own))
    w = " ".join(f"w{i}" for i in range(200))
    a, b, c, d, e, f, g = simhash_of_text.func(pd.Series([w, w.upper() + " !", w.replace("w77 ", "x "), "a b", "", " ? ", None]))
    assert a == b and 0 < ((int(a) ^ int(c)) % (1 << 64)).bit_count() <= 12 and len({d, e, f}) == 3 and pd.isna(g)


def test_synthetic_cap_takes_the_least_hashes(spark):
    import hashlib

    rows = [(i, "b" if i % 3 else "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g string")
    cap = int(0.2 / 0.8 * 1000)
    order = sorted((i for i, g in rows if g == "b"), key=lambda i: (hashlib.sha256(f"s{i}".encode()).hexdigest(), i))
    got = {r["i"] for r in records.synthetic_cap(df, F.col("g") == "b", 0.2, "i").where("g = 'b'").collect()}
    assert got == set(order[:cap])


def test_long_chain_is_reached_to_its_end(spark):
    from quern.operators import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(130)], "u long, v long")
    assert components.reachable(edges, spark.createDataFrame([(0,)], "node long")).agg({"depth": "max"}).head()[0] == 130


def test_signatures_agree_as_the_sets_do(spark):
    rng = random.Random(6)
    w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    v = w[:300] + [f"x{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v)), (3, "a b"), (4, None), (5, " ".join(w).upper())], "k long, t string")
    sig = {r["k"]: r["s"] for r in df.select("k", tx.minhash("t").alias("s")).collect()}
    exact = 296 / (396 * 2 - 296)
    assert all(len(s) == 112 for s in sig.values()) and sig[1] == sig[5]
    assert abs(sum(a == b for a, b in zip(sig[1], sig[2])) / 112 - exact) < 0.15


def test_long_headers_are_furniture():
    from quern.functions import documents as d

    header = "Official journal of the northern basin and of the rural districts around it, volume seventeen of the second series"
    text = "\n".join(f"{header}\nParagraph {i} says something of its own.\n{i}" for i in range(12))
    out = d.repair_scan(text)
    assert header not in out and out.count("Paragraph") == 12


def test_lcs_against_the_table():
    from quern.functions import documents as d

    rng = random.Random(8)
    for _ in range(200):
        a, b = (rng.choices("abc", k=rng.randrange(12)) for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                row[i][j] = row[i - 1][j - 1] + 1 if x == y else max(row[i - 1][j], row[i][j - 1])
        assert d.lcs(a, b) == row[-1][-1]


def test_merkle_proofs_of_odd_trees(spark):
    import hashlib

    from quern.operators import merkle

    rows = [(str(n), i, hashlib.sha256(f"{n}/{i}".encode()).hexdigest()) for n in (1, 2, 3, 5, 8, 11) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, p long, leaf string")
    proofs = merkle.merkle_proofs(merkle.merkle_levels(df, "s", "p", "leaf"), "s").join(merkle_root(df, "s", "p", "leaf"), "s")
    got = proofs.select("s", "pos", (merkle.proven(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), (merkle.proven(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root")).alias("bad")).collect()
    assert len(got) == len(rows) and all(r["ok"] and not r["bad"] for r in got)


def test_stand_ins_keep_who_is_who():
    from quern.functions import privacy

    a, b = privacy.stand_ins(["Write to ana@x.org or bo@y.org.", "ana@x.org called +34 600 123 456 for Mr. John Kessler"])
    assert a == "Write to <EMAIL_1> or <EMAIL_2>." and b == "<EMAIL_1> called <PHONE_1> for <PERSON_1>"
    assert privacy.stand_ins([None, "", "no one"]) == [None, "", "no one"]


def test_chunked_findings_at_the_edges(spark):
    from quern.functions import privacy

    rows = [(i, "x" * i + " ana@example.org " + "y" * 120) for i in range(0, 120, 7)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r["k"]: (r["a"], r["b"]) for r in df.select("k", privacy.findings(F.col("t")).alias("a"), privacy.chunked_findings(F.col("t"), 50, 30).alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and got[0][0] == ["email"] and got[901] == ([], [])


def test_rules_and_nulls(spark):
    from quern.operators import rules
    from quern.operators.rules import Rule

    table = [Rule("a", "x", "gt", 5, "deny"), Rule("b", "y", "prefix", "p", "review"), Rule("c", "x", "exists", False, "allow")]
    df = spark.createDataFrame([(1, 9, "pq"), (2, 1, "pq"), (3, None, None), (4, 1, "z")], "k long, x int, y string")
    got = {r["k"]: (r["m"]["effect"], r["m"]["rule"], r["s"]) for r in df.select("k", rules.first_match(table, "none").alias("m"), rules.severest(table, ["deny", "review", "allow"], "none").alias("s")).collect()}
    assert got == {1: ("deny", "a", "deny"), 2: ("review", "b", "review"), 3: ("allow", "c", "allow"), 4: ("none", None, "none")}


def test_first_duplicate_and_word_guard(spark, tmp_path):
    from quern.queries import more

    base = "the committee of the rural district reviews the usage limits before the monthly close of every year in the northern basin " * 3
    code = "def f(a):\n    b = a + 1\n    return b\n"
    files = [(1, "a.md", base), (2, "b.md", base.upper()), (3, "c.md", base + "again"), (4, "d.py", code), (5, "e.py", code.replace("a", "x").replace("b", "yy")), (6, "f.md", None), (7, "g.md", "something else")]
    spark.createDataFrame(files, "file_id long, path string, text string").write.parquet(str(tmp_path / "source_files.parquet"))
    got = {r["file_id"]: (r["match"], r["kind"]) for r in more.c3_first_duplicate(spark, str(tmp_path)).collect()}
    assert got[2] == (1, "exact") and got[3][0] == 1 and got[5] == (4, "structure") and not {1, 4, 6, 7} & set(got)
    texts = [(1, "train", "harbor quartzite lanternfish one two three"), (2, " Test", "harbor quartzite lanternfish one two four"), (3, "test", "unlike words only here"), (4, None, "harbor quartzite")]
    spark.createDataFrame(texts, "text_id long, split string, text string").write.parquet(str(tmp_path / "texts.parquet"))
    assert [tuple(r) for r in more.t39_guard(spark, str(tmp_path)).collect()] == [(2, 1, 1)]


def test_critical_paths_of_many_plans_at_once(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for p in [None, *range(400)]:
        n = rng.choice((1, 2, 5, 9))
        nodes = rng.sample([None, *range(-3, 12)], n)
        steps = [(p, x, rng.choice((-2.0, 1.0, 3.5)), rng.choice((None, [], [rng.choice([*nodes, 99, None]) for _ in range(2)]))) for x in nodes]
        rows += steps
        done, left = {}, steps
        while True:
            now = [s for s in left if all(d in done for d in s[3] or () if d is not None and d in nodes)]
            if not now:
                break
            done |= {s[1]: s[2] + max((done[d] for d in s[3] or () if d is not None and d in nodes), default=0.0) for s in now}
            left = [s for s in left if s not in now]
        want[p] = (n, None if left else max(done.values()), bool(left))
    rows += [(1000, i, 1.0, [i + 1]) for i in range(20_000)] + [(1001, 1, None, None), (1001, 2, 5.0, [1])]
    want |= {1000: (20_000, 20_000.0, False), 1001: (2, None, False)}
    rng.shuffle(rows)
    out = decisions.critical_paths(spark.createDataFrame(rows, "plan long, node long, cost double, depends array<long>"))
    got = {r["plan"]: (r["steps"], r["critical"], r["cyclic"]) for r in out.collect()}
    assert got == want and len({c for _, _, c in want.values()}) == 2
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # one call for each plan
    names = spark.createDataFrame([(7, "b", 2.0, ["a"]), (7, "a", 1.0, []), (7, "c", 9.0, ["c"]), (8, "a", 4.0, ["b"]), (8, "a", None, []), (8, "a", 3.0, [])], "plan int, node string, cost double, depends array<string>")
    assert {tuple(r) for r in decisions.critical_paths(names).collect()} == {(7, 3, None, True), (8, 1, 4.0, False)}
    assert decisions.critical_paths(names.limit(0)).count() == 0


def test_proofs_of_whole_streams_by_blocks(spark, tmp_path):
    import hashlib

    import __spark_entry__ as entry
    from quern.operators import merkle

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(str(n), i, h(f"{n}/{i}")) for n in (1, 2, 3, 63, 64, 65, 128, 129, 4097) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, p long, leaf string")
    roots = dict(map(tuple, merkle_root(df, "s", "p", "leaf").collect()))
    got = merkle.proven_leaves(df, "s", "p", F.col("leaf")).collect()
    assert {r["s"]: (r["root"], r["leaves"], r["proven"]) for r in got} == {s: (root, int(s), int(s)) for s, root in roots.items()}
    levels = merkle.block_levels([h(str(i)).encode() for i in range(5)], 3)
    proof = merkle.block_proof(levels, 4)
    assert merkle.leads_to(levels[0][4], proof) == levels[-1][0] != merkle.leads_to(levels[0][3], proof)
    orders = [(i * 7 % 3001, random.Random(i).choice((None, "F", "O")), f"p{i % 5}") for i in range(3001)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    counts = Counter(s for _, s, _ in orders)  # orders without a status are a stream as well, as in SQL
    assert {tuple(r) for r in entry.queries()["h3_merkle_proofs"](spark, str(tmp_path)).collect()} == {(s, n, n) for s, n in counts.items()}
    placed = merkle.placed(spark.createDataFrame(orders, "k long, s string, x string"), "s", "k").collect()
    want = {s: sorted(k for k, t, _ in orders if t == s) for s in counts}
    assert len(placed) == 3001 and all(want[r["s"]][r["pos"]] == r["k"] for r in placed)
