"""Corpus cleaning: exact and near duplicates, decontamination, and the funnel that gives each document one outcome."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.hashing import hash_bucket
from quern.functions.privacy import PATTERNS
from quern.session import drop_spill, spill, spread

BANDS, BAND_ROWS, NEAR = 14, 8, 0.8


def exact_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first, copies): each document with the first of its exact copies (after normalising) and their number.

    The text is hashed before the shuffle; the groups are aggregated before they are joined back."""
    hashed = docs.select(key, F.sha2(tx.normalize_text(F.col(text)), 256).alias("h")).where("h is not null")
    return hashed.join(hashed.groupBy("h").agg(F.min(key).alias("first"), F.count("*").alias("copies")), "h").select(key, "first", "copies")


def ngram_hashes(tokens: Column, n: int = 13) -> Column:
    return F.transform(tx.ngrams(tokens, n), lambda g: F.xxhash64(g))


def contaminated(docs: DataFrame, evaluation: DataFrame, key: str, text: str, n: int = 13) -> DataFrame:
    """(key) of documents that share a run of n words with an evaluation text (Brown et al. 2020)."""
    held = evaluation.select(F.explode(ngram_hashes(tx.word_tokens(F.col(text)), n)).alias("g")).distinct()
    held, _ = spill(held, "ngrams")  # its size is known from the files, so the join is planned by it
    grams = spread(docs.select(key, text)).select(key, F.explode(F.array_distinct(ngram_hashes(tx.word_tokens(F.col(text)), n))).alias("g"))
    return grams.join(held, "g", "left_semi").select(key).distinct()


def near_edges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, agreement) with a < b: documents whose minwise signatures agree in 0.8 of the places, by 14 bands of 8 rows.

    Equal signatures are one class; classes are compared, and members other than the first hang on it by one edge each."""
    signed, _ = spill(spread(docs.where(F.col(text).isNotNull()).select(key, text)).select(F.col(key).alias("id"), tx.minhash(F.col(text)).alias("sig")), "signatures")
    signed = signed.withColumn("cls", F.struct(F.xxhash64("sig").alias("x"), F.xxhash64(F.lit(1), "sig").alias("y")))
    classes = signed.groupBy("cls").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("id"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.slice("sig", b * BAND_ROWS + 1, BAND_ROWS)))
    banded = classes.select("id", F.posexplode(bands).alias("band", "h"))
    met = banded.select("band", "h", F.col("id").alias("a")).join(banded.select("band", "h", F.col("id").alias("b")), ["band", "h"]).where("a < b").select("a", "b").distinct()
    with_sigs = met.join(classes.select(F.col("sig").alias("sa"), F.col("id").alias("a")), "a").join(classes.select(F.col("sig").alias("sb"), F.col("id").alias("b")), "b")
    agreement = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(BANDS * BAND_ROWS)
    between = with_sigs.select("a", "b", agreement.alias("agreement")).where(F.col("agreement") >= NEAR)
    within = signed.select("cls", "id").join(classes.select("cls", F.col("id").alias("a")), "cls").where("a <> id").select("a", F.col("id").alias("b"), F.lit(1.0).alias("agreement"))
    return between.unionByName(within)


def greedy_keep(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, kept): in the order of ids a node is kept unless an earlier kept one is its neighbour (the lexicographically first
    maximal independent set): undecided nodes whose earlier neighbours are all dropped are kept, and their later neighbours
    dropped, until nothing is undecided. Rounds follow the longest chain of near duplicates."""
    spark = nodes.sparkSession
    edges, edge_path = spill(edges.select("a", "b").distinct(), "near")
    touched = edges.select(F.col("b").alias("id")).distinct()
    free = nodes.select("id").join(touched, "id", "left_anti").withColumn("kept", F.lit(True))
    state, path = spill(touched.withColumn("kept", F.lit(None).cast("boolean")), "greedy")
    for _ in range(max_rounds):
        known = free.unionByName(state)
        ahead = edges.join(known.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("ka", F.lit(False))).alias("hit"), F.count_if(F.col("ka").isNull()).alias("open"))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.col("open") == 0, True)
        after, new_path = spill(state.join(ahead, "id").select("id", decided.alias("kept")), "greedy")
        drop_spill(spark, path)
        state, path = after, new_path
        if state.where("kept is null").isEmpty():
            break
    else:
        raise RuntimeError("near duplicates aren't decided")
    return free.unionByName(state)


def funnel(docs: DataFrame, key: str, text: str, evaluation: DataFrame | None = None, holdout: int = 2, formulaic: str | None = None, licensed: Column | None = None) -> DataFrame:
    """(key, reason, split): one outcome for each document: licence (where a condition is given that a document has to meet), too
    short and the like, style, credential, contaminated, duplicate, near_duplicate, or kept (null reason) with its split.

    formulaic: a boolean column of documents that repeat phrases by nature (official law), for which the n-gram rules don't hold.

    Cheap rules come first; only survivors are hashed, and only distinct survivors get a signature. Equal copies of a
    near-duplicate reject are near duplicates too, as the copies of a class share its fate but for the first of a kept one."""
    admitted = F.lit(True) if licensed is None else F.coalesce(licensed, F.lit(False))
    basic = docs.select(key, text, admitted.alias("__licensed"), (~F.col(formulaic) if formulaic else F.lit(True)).alias("__prose")).withColumn("basic", F.when(~F.col("__licensed"), "licence").otherwise(tx.basic_reason(F.col(text))))
    judged = tx.with_quality(basic, text, min_words=20, repetition=F.col("basic").isNull() & F.coalesce("__prose", F.lit(True))).select(key, text, F.coalesce("basic", "quality").alias("reason"))
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.col(text).rlike(PATTERNS["credential"]), "credential")))
    judged, _ = spill(judged, "judged")
    passed = judged.where("reason is null").select(F.col(key).alias("id"), F.col(text).alias("text"))
    if evaluation is not None:  # ids only: texts are written once
        leaked, _ = spill(contaminated(passed, evaluation, "id", "text"), "leaked")
    else:
        leaked = passed.select("id").limit(0)
    clean = passed.join(leaked, "id", "left_anti")
    groups, _ = spill(exact_groups(clean, "id", "text"), "groups")
    firsts = clean.join(groups.where("id = first").select("id"), "id", "left_semi")
    kept = greedy_keep(firsts.select("id"), near_edges(firsts, "id", "text"))
    fate = groups.join(kept.select(F.col("id").alias("first"), "kept"), "first").select("id", F.when(~F.col("kept"), "near_duplicate").when(F.col("id") != F.col("first"), "duplicate").alias("fate"))
    outcome = judged.select(F.col(key), "reason").join(leaked.select(F.col("id").alias(key), F.lit(True).alias("leaked")), key, "left").join(fate.select(F.col("id").alias(key), "fate"), key, "left")
    reason = F.coalesce("reason", F.when(F.col("leaked"), "contaminated"), "fate")
    split = F.when(reason.isNull(), F.when(hash_bucket(F.col(key).cast("string"), 100) < holdout, "validation").otherwise("train"))
    return outcome.select(key, reason.alias("reason"), split.alias("split"))
