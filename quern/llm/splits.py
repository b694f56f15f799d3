"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing.

Two texts are bound if they share a family hash, an author or a source name. Each value binds its texts to the smallest of
them (a star, not all pairs). Clusters are rows (node, member), never arrays, so a component that holds a third of all texts
is spread over the tasks: each round a node sends its cluster to its minimum and its minimum to its cluster, as a distinct
union of rows; the minima are pre-aggregated before the shuffle, and adaptive execution splits a skewed node. Rounds end when
the set of rows stays as it was; every round is written to the shared folder. The number of rounds is logarithmic in the
diameter.

Blank values, and authors that name nobody, bind nothing. Null text_ids are left out; repeated ones count once. Family rows of
texts that are not there bind nothing.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.textform import folded
from quern.session import drop_spill, spill

#: What stands in an author field for nobody. Folded, and compared without dots, spaces, dashes and the like.
NOBODY = (
    # unknown, nameless and anonymous
    "unknown", "unknownauthor", "authorunknown", "unnamed", "nameless", "noname", "noauthor", "anonymous", "anonym", "anon", "nobody", "unattributed", "notknown",
    "desconocido", "desconocida", "autordesconocido", "sinautor", "sinnombre", "anonimo", "anonima", "nadie", "ignorado",
    "inconnu", "inconnue", "auteurinconnu", "sansauteur", "sansnom", "anonyme", "personne",
    "unbekannt", "unbekannter", "unbekannterautor", "autorunbekannt", "verfasserunbekannt", "namenlos", "ohneautor", "ohnename", "ohnenamen", "anonymus", "niemand",
    "desconhecido", "desconhecida", "autordesconhecido", "semautor", "semnome", "ninguem",
    "sconosciuto", "sconosciuta", "ignoto", "ignota", "autoresconosciuto", "autoreignoto", "senzanome", "senzaautore", "nessuno",
    "desconegut", "desconeguda", "autordesconegut", "senseautor", "sensenom", "anonim", "ningu",
    # not available and the like
    "na", "notavailable", "notapplicable", "nodisponible", "noconsta", "nondisponible", "nichtverfugbar", "naodisponivel", "nondisponibile", "keineangabe", "noprocede", "null", "none", "nil", "nan", "undefined", "unspecified", "tbd",
    # abbreviations
    "nn", "sa", "sn", "sd", "an", "oa", "ov", "ka", "unk", "anonymousauthor", "xxx", "xx", "x",
)

WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}
_ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñçß", "aaaaaaeeeeiiiiooooouuuuncs")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def somebody(author: Column) -> Column:
    """A folded author, or null if it names nobody: no letter or digit at all, or a word for nobody."""
    bare = F.regexp_replace(F.translate(author, *_ACCENTS), r"[^\p{L}\p{N}]+", "")
    return F.when((bare != "") & ~bare.isin(*NOBODY), author)


def bindings(texts: DataFrame, families: DataFrame) -> DataFrame:
    """(kind, value, text_id): what each text shares."""
    own = texts.where("text_id is not null").select("text_id", folded(texts["author"]).alias("author"), folded(texts["source_name"]).alias("source"))
    by_field = own.select("text_id", F.explode(F.array(F.struct(F.lit("a").alias("kind"), somebody(F.col("author")).alias("value")), F.struct(F.lit("s").alias("kind"), blank_to_null(F.col("source")).alias("value")))).alias("x")).select("x.kind", "x.value", "text_id")
    family = blank_to_null(F.regexp_replace(F.regexp_replace(F.lower(families["hash"]), r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""), r"^sha256:\s*", ""))
    by_family = families.select(F.lit("f").alias("kind"), family.alias("value"), F.col("text_id")).join(own.select("text_id"), "text_id", "left_semi").select("kind", "value", "text_id")
    return by_field.unionByName(by_family).where("value is not null")


def stars(bound: DataFrame) -> DataFrame:
    """(u, v): each text with the smallest text of each of its values, where that is another one."""
    centre = bound.groupBy("kind", "value").agg(F.min("text_id").alias("v"), F.max("text_id").alias("most")).where("v < most")
    return bound.join(centre, ["kind", "value"]).where("text_id <> v").select(F.col("text_id").alias("u"), "v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(text_id, group_id): hash-to-min over the undirected edges (u, v); texts without an edge don't come out."""
    spark = edges.sparkSession
    first = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")), F.struct("u", F.col("u").alias("v")), F.struct(F.col("v").alias("u"), F.col("v").alias("v")))).alias("x")).select("x.u", "x.v").distinct()
    cluster, path = spill(first, "cluster")
    state = _state(cluster)
    for _ in range(max_rounds):
        least = cluster.groupBy("u").agg(F.min("v").alias("m"))
        sent = cluster.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("m").alias("u"), "v"))).alias("x")).select("x.u", "x.v").distinct()
        after, new_path = spill(sent, "cluster")
        new_state = _state(after)
        drop_spill(spark, path)
        cluster, path = after, new_path
        if new_state == state:
            return cluster.groupBy(F.col("u").alias("text_id")).agg(F.min("v").alias("group_id"))
        state = new_state
    raise RuntimeError(f"components aren't stable after {max_rounds} rounds")


def _state(cluster: DataFrame) -> tuple:
    return tuple(cluster.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def groups(texts: DataFrame, families: DataFrame) -> DataFrame:
    """(text_id, group_id) of each text that is bound to another."""
    return components(stars(bindings(texts, families)))


def _unit(c: Column, split: str, seed: int) -> Column:
    """A number in (0, 1) drawn by hash for a group and a split."""
    return (F.shiftrightunsigned(F.xxhash64(c, F.lit(split), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _chosen(weights: dict[str, float], draws: dict[str, float]) -> str:
    return min((-math.log(draws[s]) / w, s) for s, w in sorted(weights.items()) if w > 0)[1]


def size_weights(sizes: list[tuple[int, int, dict[str, float]]], weights: dict[str, float]) -> dict[int, dict[str, float]]:
    """Weights of the splits for groups of each size. sizes: (size, groups of that size, draws of the one group if there is one).

    From the largest size on, a split can take a group if it still has that much room (if none has, the one with most), and its
    weight is its room. What a size takes of the rooms is what its weights say on average, or what its only group draws."""
    total = sum(n * c for n, c, _ in sizes)
    room = {s: w / sum(weights.values()) * total for s, w in weights.items()}
    out = {}
    for n, count, draws in sorted(sizes, reverse=True, key=lambda x: x[0]):
        able = {s: r for s, r in room.items() if r >= n} or {max(room, key=lambda s: (room[s], s)): 1.0}
        out[n] = able
        for s in [_chosen(able, draws)] if count == 1 else able:
            room[s] -= n if count == 1 else n * count * able[s] / sum(able.values())
    return out


def assign(texts: DataFrame, families: DataFrame, weights: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """(text_id, group_id, split): one split for each group; a text that nothing binds is a group of its own.

    Weighted rendezvous hashing: each group draws a number for each split, and the least of -log(draw) / weight wins. The weights
    are those of the group's size (size_weights), by one rule for all sizes: a group never goes where it has no room while
    another split has, and the groups after it make up for what it took. The driver holds one row for each size that occurs, at
    most the square root of twice the number of texts. As rooms depend on the sizes, new texts shift the weights a little, and
    groups whose draws lie near the border may move; with the same sizes all stay."""
    weights = weights or WEIGHTS
    every = texts.where("text_id is not null").select("text_id").distinct()
    labelled, _ = spill(every.join(groups(texts, families), "text_id", "left").select("text_id", F.coalesce("group_id", "text_id").alias("group_id")), "labelled")
    sized = labelled.groupBy("group_id").agg(F.count("*").alias("n"))
    draws = [_unit(F.col("group_id"), s, seed).alias(s) for s in sorted(weights)]
    each = sized.groupBy("n").agg(F.count("*").alias("groups"), F.min("group_id").alias("group_id")).select("n", "groups", F.struct(*draws).alias("draws")).collect()
    by_size = size_weights([(r["n"], r["groups"], r["draws"].asDict()) for r in each], weights)
    table = labelled.sparkSession.createDataFrame([(n, *[float(w.get(s, 0.0)) for s in sorted(weights)]) for n, w in by_size.items()], "n bigint, " + ", ".join(f"`w_{s}` double" for s in sorted(weights)))
    scores = [F.struct(F.when(F.col(f"w_{s}") > 0, -F.log(_unit(F.col("group_id"), s, seed)) / F.col(f"w_{s}")).otherwise(float("inf")).alias("score"), F.lit(s).alias("split")) for s in sorted(weights)]
    placed = sized.join(table, "n").select("group_id", F.array_min(F.array(*scores))["split"].alias("split"))
    return labelled.join(placed, "group_id").select("text_id", "group_id", "split")


def shares(assigned: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Texts, groups and share of each split beside its target."""
    weights = weights or WEIGHTS
    whole = sum(weights.values())
    target = assigned.sparkSession.createDataFrame([(s, w / whole) for s, w in weights.items()], "split string, target_share double")
    counts = assigned.groupBy("split").agg(F.count("*").alias("texts"), F.countDistinct("group_id").alias("groups"))
    n = F.coalesce("texts", F.lit(0))
    return target.join(counts, "split", "left").select("split", "target_share", n.alias("texts"), F.coalesce("groups", F.lit(0)).alias("groups"), (n / F.sum("texts").over(Window.partitionBy())).alias("actual_share"))  # one row a split


def contradictions(texts: DataFrame, families: DataFrame) -> DataFrame:
    """(group_id, splits): groups of which families.split puts texts on more than one side."""
    recorded = families.select("text_id", F.lower(F.trim("split")).alias("split")).where("split <> ''")
    return recorded.join(groups(texts, families), "text_id").groupBy("group_id").agg(F.array_sort(F.collect_set("split")).alias("splits")).where("size(splits) > 1")


