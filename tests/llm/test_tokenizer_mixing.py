"""Encoding against two libraries and round trips; mixes against their targets."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
from quern.llm import mixing, tokenizer  # noqa: E402
from quern.llm.tokenizer import Bpe, boundaries  # noqa: E402

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATH = f"{tokenizer.TOKENIZER_DIR}/{tokenizer.BYTE_BPE}"
ODD = ["", " ", "  a", "a  ", "\n\n x", "a\t\tb", "it's we'll 's ''s 've'x 'lla", "'", "x'", "1a 2 b٢", "naïve café", "日本語 テスト", "🙂🙂 ok", "  x", "a" * 3000, " " * 500 + "b", "<|endoftext|>", "\r\n\r\n"]


@pytest.fixture(scope="module")
def model():
    return Bpe(PATH)


@pytest.fixture(scope="module")
def reference(model):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def lists(model, texts):
    ids, n = model.encode_batch(texts)
    ends = np.r_[0, np.cumsum(n)]
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_odd_texts(model, reference):
    assert lists(model, ODD) == [reference.encode_ordinary(t) for t in ODD]
    assert lists(model, []) == []


@given(st.lists(st.text(alphabet=st.sampled_from("abstrevmdl'’ \t\n1٢é字🙂.,!　"), max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_random_texts(model, reference, texts):
    got = lists(model, texts)
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [model.decode(x).decode("utf-8") for x in got] == texts


def test_same_ids_as_the_json_vocabulary(model):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    assert lists(model, ODD) == [e.ids for e in other.encode_batch(ODD, add_special_tokens=False)]


def test_guards_keep_texts_apart():
    points = np.array([0x110000, 97, 0x110000, 32, 0x110000, 98, 0x110000], dtype=np.uint32)
    assert boundaries(points).tolist() == [False, True, False, True, False, True, False]


def test_columns(spark, model, reference):
    rows = list(enumerate([*ODD, None])) + [(0, ODD[6])]
    df = spark.createDataFrame([(i, t, [9]) for i, t in rows], "doc_id long, text string, ids array<int>")
    got = tokenizer.encode(df, offsets=True).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted((i, tuple(reference.encode_ordinary(t or ""))) for i, t in rows)
    for r in got:
        data = dict(rows)[r["doc_id"]] if r["doc_id"] else None
        if data:
            assert [data.encode()[o : o + len(model.tokens[i])] for i, o in zip(r["ids"], r["offsets"])] == [model.tokens[i] for i in r["ids"]]
    counts = {r["doc_id"]: r["tokens"] for r in tokenizer.count_tokens(df.where("doc_id > 0")).collect()}
    assert counts == {i: len(reference.encode_ordinary(t or "")) for i, t in rows if i}
    back = {r["doc_id"]: r["text"] for r in tokenizer.decode(tokenizer.encode(df.where("doc_id > 0"))).collect()}
    assert back == {i: t or "" for i, t in rows if i}
    assert tokenizer.encode(df.limit(0)).count() == 0


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    tokens, pi = rng.integers(1, 900, 400), rng.random(400)
    out = mixing.flight(pi, tokens, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs((out * tokens).sum() - (pi * tokens).sum()) < 1e-3 and abs(out.sum() - pi.sum()) < 1e-6
    landed = mixing.landing(out, tokens)
    assert set(landed.tolist()) <= {0.0, 1.0} and abs((landed * tokens).sum() - (pi * tokens).sum()) < 30


def test_flight_is_unbiased():
    hits, pi, tokens = np.zeros(6), np.array([0.1, 0.3, 0.5, 0.7, 0.9, 0.5]), np.array([5, 9, 20, 4, 7, 7])
    for s in range(3000):
        rng = np.random.default_rng(s)
        out = mixing.flight(pi, tokens, rng)
        hits += np.where((out > 0) & (out < 1), rng.random(6) < out, out)
    assert np.abs(hits / 3000 - pi).max() < 0.05


DOCS, TARGETS = "doc_id long, text string, source string, tokens int, part int", "mix_name string, source string, target_weight double, max_repeats int"


def test_mix_reaches_its_shares(spark):
    rng = random.Random(2)
    words = ["sun", "moon", "stars", "harbour", "lantern", "ten"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 200))), s, 1, 2) for i, s in enumerate(["Big A"] * 600 + [" big  a"] * 200 + ["Small"] * 20 + ["Other"] * 50)]
    docs += [(-1, None, "Small", 1, 2), (-2, "", "Big A", 1, 2), (-3, "x", None, 1, 2)]
    targets = [("m", "BIG A", 0.5, 1), ("m", "Small", 0.3, 3), ("m", "Absent", 0.2, 2), ("empty", "Absent", 1.0, 1), ("m2", "Other", 1.0, 2)]
    records, shares = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), block_rows=90)
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert abs(got["m", "BIG A"]["actual_share"] - 0.625) < 0.002 and abs(got["m", "Small"]["actual_share"] - 0.375) < 0.002
    assert got["m", "Absent"]["actual_share"] == 0 and got["empty", "Absent"]["tokens"] == 0 and got["m2", "Other"]["copies"] == 100
    rows = records.collect()
    assert max(r["repeats"] for r in rows if r["source"] == "Small") == 3 and all(r["repeats"] == 1 for r in rows if r["source"] == "BIG A")
    assert len({(r["mix_name"], r["doc_id"]) for r in rows}) == len(rows) and min(r["doc_id"] for r in rows) >= 0


def test_scarce_source_gives_all_it_may(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "a" if i < 5 else "b", 0, 0) for i in range(100)], DOCS)
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2)], TARGETS)
    _, shares = mixing.mix(docs, targets, total_tokens=2400)
    got = {r["source"]: r for r in shares.collect()}
    assert got["a"]["copies"] == 10 and 0.65 < got["b"]["actual_share"] < 0.75


def test_nothing_to_mix(spark):
    none, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    for docs, t in ((none, targets), (none, targets.limit(0))):
        records, shares = mixing.mix(docs, t)
        assert records.count() == 0 and shares.count() == t.count()
