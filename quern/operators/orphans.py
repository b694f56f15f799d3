"""References to records that do not exist, by compressed bitmaps.

Plan: 1. child rows are reduced to the first delivery of each id and, beside it, to distinct (key, table, month) with map-side
combine, so a key that holds a third of the rows counts once per month; 2. keys are hashed into ranges of bounded size, each
range dictionary-encodes its keys as integers and builds one bitmap of references per table and month, one bitmap of the
parents that exist by then, and takes reference AND-NOT parent; 3. the surviving bits are decoded to keys with their cause and
joined to the deliveries. The last join is an equi-join on (key, table, month); adaptive execution splits a skewed key, since
the other side holds one row per key. Nothing is collected or broadcast by hand.

Null, blank and all-zero keys are no reference. Rows without an id are left out (nothing could name them). A null ingested_at
of a child is never late; a parent whose ingested_at is always null counts as present from the start.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.bitmap import Bitmap
from quern.session import parallelism

PADDING = " \t\n\r\f\v ​﻿"
ZERO = "0" * 32
#: Distinct keys and references that one range may hold at most, on average.
RANGE_ROWS = 200_000

SURVIVOR = "key binary, child_table string, month string, cause string, first_us bigint"


def norm_key(c: Column) -> Column:
    """A key without letter case, padding, dashes, braces and the urn:uuid: prefix; null if it refers to nothing."""
    k = F.btrim(F.translate(F.lower(F.btrim(c, F.lit(PADDING))), "{}-", ""), F.lit(PADDING))
    k = F.regexp_replace(k, "^urn:uuid:", "")
    return F.when((k != "") & (k != ZERO), k)


def pack_key(k: Column) -> Column:
    """16 bytes for 32 hexadecimal digits, else the text behind a mark."""
    return F.when(k.rlike("^[0-9a-f]{32}$"), F.unhex(k)).otherwise(F.encode(F.concat(F.lit("~"), k), "utf-8"))


def current_parents(parent: DataFrame, key: str = "id") -> DataFrame:
    """(key, first_us, deleted): the first arrival of each key and whether its latest version is deleted.

    Of versions that arrived at the same time, a deleted one counts."""
    return (
        parent.select(pack_key(norm_key(F.col(key))).alias("key"), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("us"), F.col("deleted_at").isNotNull().alias("gone"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.coalesce(F.min("us"), F.lit(-(2**62))).alias("first_us"), F.max(F.struct("us", "gone"))["gone"].alias("deleted"))
    )


def deliveries(child: DataFrame, name: str, key: str = "task_id") -> DataFrame:
    """(child_table, id, us, key, month): the first delivery of each id that refers to something."""
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit(""))
    row = F.struct(F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("us"), pack_key(norm_key(F.col(key))).alias("key"), month.alias("month"))
    first = child.where("id is not null").select("id", row.alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return first.select(F.lit(name).alias("child_table"), "id", "row.us", "row.key", "row.month").where("key is not null")


def _orphans_of_range(pdf: pd.DataFrame) -> pd.DataFrame:
    codes, keys = pd.factorize(pdf["key"])
    is_parent = pdf["child_table"].isna().to_numpy()
    first = np.full(len(keys), np.iinfo(np.int64).max)
    gone = np.zeros(len(keys), dtype=bool)
    known = codes[is_parent]
    first[known] = pdf["us"].to_numpy()[is_parent]
    gone[known] = pdf["deleted"].eq(True).to_numpy()[is_parent]
    every, deleted = Bitmap.of(known), Bitmap.of(np.flatnonzero(gone))
    alive = every.and_not(deleted)
    out = []
    refs = pdf[~is_parent]
    ref_codes, ref_us = codes[~is_parent], refs["us"].to_numpy()
    for (name, month), at in refs.groupby(["child_table", "month"], sort=False).indices.items():
        of = ref_codes[at]
        referred = Bitmap.of(of)
        present = alive.and_not(Bitmap.of(of[ref_us[at] < first[of]]))  # parents that had come by the first reference
        left = referred.and_not(present).decode()
        if len(left):
            missing = np.isin(left, referred.and_not(every).decode(), assume_unique=True)
            cause = np.where(missing, "missing", np.where(gone[left], "deleted", "late"))
            out.append(pd.DataFrame({"key": [keys[i] for i in left], "child_table": name, "month": month, "cause": cause, "first_us": np.where(missing, 0, first[left])}))
    if not out:
        return pd.DataFrame(columns=["key", "child_table", "month", "cause", "first_us"], dtype=object)
    return pd.concat(out, ignore_index=True)


def orphans(parent: DataFrame, children: dict[str, DataFrame], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(child_table, id, month, cause) of each child id whose reference is missing, deleted or late."""
    spark = parent.sparkSession
    rows = parent.count() + sum(c.count() for c in children.values())  # from file footers
    ranges = max(parallelism(spark), -(-rows // range_rows))
    refs = None
    for name, child in children.items():
        one = deliveries(child, name)
        refs = one if refs is None else refs.unionByName(one)
    grouped = refs.groupBy("key", "child_table", "month").agg(F.coalesce(F.min("us"), F.lit(2**62)).alias("us"), F.lit(None).cast("boolean").alias("deleted"))
    known = current_parents(parent).select("key", F.lit(None).cast("string").alias("child_table"), F.lit(None).cast("string").alias("month"), F.col("first_us").alias("us"), "deleted")
    both = grouped.unionByName(known).withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)))
    left = both.groupBy("range").applyInPandas(_orphans_of_range, SURVIVOR)
    found = refs.join(left, ["key", "child_table", "month"]).where("cause <> 'late' or us < first_us")
    return found.select("child_table", "id", "month", "cause")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, month of created_at and cause."""
    return found.groupBy("child_table", "month", "cause").agg(F.count("*").alias("n"))
