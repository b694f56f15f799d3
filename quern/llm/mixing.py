"""Mixes of sources by target shares of tokens: cube-method balanced sampling.

A mix takes every record of a source r times in expectation, r = share x total / tokens of the source. total is the largest
size at which no source needs a record more often than max_repeats; the sources that a mix names and that hold no token share
their target among the others, and come out with an actual share of zero. If total_tokens is given and is larger, scarce
sources give all their repeats and fall short, the others keep their tokens.

floor(r) copies are certain; the fraction left is an inclusion probability. The cube method moves the probabilities of a
source through the null-space of its two constraints (tokens, documents) until at most two of a block are fractional; blocks
hold block_rows records at most (by hash, so a source that holds a third of all rows is split), what they leave is balanced
again in the next round, and the last two records of a source are rounded so that its tokens come out closest. Nothing is
collected but one row for each source that a mix names; mixes are a configuration, bounded by MAX_TARGETS.

Null, empty and token-less texts are left out. Repeated doc_ids are records of their own. Sources agree up to letter case,
spacing and Unicode form. Without targets or without matching records the result is empty.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textform import fold, folded
from quern.llm.tokenizer import BYTE_BPE, count_tokens
from quern.session import spill

MAX_TARGETS = 100_000
BLOCK_ROWS = 20_000
SEED = 20240229

_FLOWN = "mix_name string, source string, doc_id bigint, tokens bigint, base int, pi double, part bigint"


def flight(pi: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities moved to 0 or 1 with the sums of tokens and of documents kept, all but two at most."""
    pi = pi.copy()
    held: list[int] = []
    draws = rng.random(len(pi) + 1)
    eps = 1e-9
    for i in range(len(pi)):
        if not eps < pi[i] < 1 - eps:
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (float(tokens[c] - tokens[b]), float(tokens[a] - tokens[c]), float(tokens[b] - tokens[a]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for x, k in zip(u, held):
            if x > 0:
                up, down = min(up, (1 - pi[k]) / x), min(down, pi[k] / x)
            elif x < 0:
                up, down = min(up, pi[k] / -x), min(down, (1 - pi[k]) / -x)
        step = up if draws[i] * (up + down) < down else -down
        for x, k in zip(u, held):
            pi[k] += step * x
        held = [k for k in held if eps < pi[k] < 1 - eps]
    return np.where(pi <= eps, 0.0, np.where(pi >= 1 - eps, 1.0, pi))


def landing(pi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The few probabilities that are still fractional, rounded so that the tokens stay closest to their expectation; then
    one record taken and one left are exchanged if that brings the tokens closer still."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(open_):
        return pi
    want, docs = float((pi[open_] * tokens[open_]).sum()), float(pi[open_].sum())
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(choices @ tokens[open_] - want) + 1e-9 * np.abs(choices.sum(1) - docs)
    out = pi.copy()
    out[open_] = choices[off.argmin()]
    excess = float(choices[off.argmin()] @ tokens[open_] - want)
    taken, rest = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
    if len(taken) and len(rest):
        rest = rest[np.argsort(tokens[rest], kind="stable")]
        aim = tokens[taken] - excess
        at = np.clip(np.searchsorted(tokens[rest], aim), 1, len(rest)) - 1
        at = np.where((at + 1 < len(rest)) & (np.abs(tokens[rest[np.minimum(at + 1, len(rest) - 1)]] - aim) < np.abs(tokens[rest[at]] - aim)), at + 1, at)
        gap = np.abs(tokens[rest[at]] - aim)
        k = int(gap.argmin())
        if gap[k] < abs(excess):
            out[taken[k]], out[rest[at[k]]] = 0.0, 1.0
    return out


def _balance(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable")
        key = f"{SEED}/{pdf['mix_name'].iat[0]}/{pdf['source'].iat[0]}/{pdf['part'].iat[0]}/{last}"
        rng = np.random.default_rng(np.frombuffer(key.encode("utf-8"), dtype=np.uint8))
        tokens = pdf["tokens"].to_numpy()
        order = np.lexsort((rng.random(len(pdf)), -tokens))  # small records last, so that little is left open
        pi = np.empty(len(pdf))
        pi[order] = flight(pdf["pi"].to_numpy()[order], tokens[order], rng)
        return pdf.assign(pi=landing(pi, tokens) if last else pi)

    return run


def plan(targets: list, totals: dict[str, int], total_tokens: int | None = None) -> list[tuple]:
    """(mix_name, source, folded source, target share, max_repeats, expected repeats) of each target."""
    out = []
    for mix in sorted({t["mix_name"] for t in targets if t["mix_name"] is not None}):
        own: dict[str, list] = {}
        for t in targets:
            if t["mix_name"] == mix and t["source"] is not None:
                x = own.setdefault(fold(t["source"]), [t["source"], 0.0, 0])
                x[1] += t["target_weight"] or 0.0
                x[2] = max(x[2], t["max_repeats"] or 0)
        there = {s: x for s, x in own.items() if x[1] > 0 and x[2] > 0 and totals.get(s, 0) > 0}
        weight = sum(x[1] for x in there.values())
        size = min((x[2] * totals[s] / (x[1] / weight) for s, x in there.items()), default=0.0)
        size = size if total_tokens is None else float(total_tokens)
        for s, x in own.items():
            r = min(float(x[2]), x[1] / weight * size / totals[s]) if s in there else 0.0
            out.append((mix, x[0], s, x[1], x[2], r))
    return out


PLAN = "mix_name string, source string, folded string, target_share double, max_repeats int, repeats double"


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = BYTE_BPE, total_tokens: int | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(records: mix_name, source, doc_id, repeats, tokens; shares: per mix and source what it was to hold and holds)."""
    spark = docs.sparkSession
    wanted = targets.select("mix_name", "source", "target_weight", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    names = sorted({fold(t["source"]) for t in wanted if t["source"] is not None})
    named = spark.createDataFrame([(n,) for n in names], "folded string")
    own = docs.select(docs["doc_id"].alias("doc_id"), folded(docs["source"]).alias("folded"), docs["text"].alias("text"))
    sized, _ = spill(count_tokens(own.join(F.broadcast(named), "folded", "left_semi"), keep=["doc_id", "folded"], tokenizer=tokenizer).where("tokens > 0"), "sized")
    stats = sized.groupBy("folded").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()  # one row for each source a mix names
    rows = plan(wanted, {s["folded"]: s["tokens"] for s in stats}, total_tokens)
    blocks = {s["folded"]: -(-s["docs"] // block_rows) for s in stats}
    planned = spark.createDataFrame(rows, PLAN)
    sizes = spark.createDataFrame([(k, v) for k, v in blocks.items()], "folded string, blocks bigint")
    base = F.floor(F.col("repeats") + 1e-9).cast("int")
    probability = F.col("repeats") - base
    drawn = (
        sized.join(F.broadcast(planned.where("repeats > 0").join(sizes, "folded")), "folded")
        .select("mix_name", "source", "doc_id", "tokens", base.alias("base"), F.when(probability > 1e-9, probability).otherwise(0.0).alias("pi"), F.pmod(F.xxhash64("doc_id", "mix_name", F.lit(SEED)), F.col("blocks")).alias("part"))
    )
    most = max(blocks.values(), default=1)
    certain = drawn.where("pi = 0")
    flown = drawn.where("pi > 0")
    settled = certain
    while most > 1:  # each round leaves two records of a block, so the blocks shrink by block_rows / 2
        flown, _ = spill(flown.groupBy("mix_name", "source", "part").applyInPandas(_balance(False), _FLOWN), "flown")
        settled = settled.unionByName(flown.where("pi = 0 or pi = 1"))
        most = -(-most * 2 // block_rows)
        flown = flown.where("pi > 0 and pi < 1").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(most)), F.lit(most)))
    last = flown.withColumn("part", F.lit(0).cast("bigint")).groupBy("mix_name", "source", "part").applyInPandas(_balance(True), _FLOWN)
    records = settled.unionByName(last).select("mix_name", "source", "doc_id", (F.col("base") + F.col("pi").cast("int")).alias("repeats"), "tokens").where("repeats > 0")
    held = records.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").alias("copies"), F.count("*").alias("docs"), F.max("repeats").alias("most_repeats"))
    total = F.sum("tokens").over(_by_mix())
    shares = (
        planned.join(held, ["mix_name", "source"], "left")
        .select("mix_name", "source", "target_share", "max_repeats", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("tokens", "copies", "docs", "most_repeats")])
        .select("*", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"))
    )
    return records, shares


def _by_mix():
    from pyspark.sql import Window

    return Window.partitionBy("mix_name")
