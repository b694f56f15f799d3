"""Hashes that agree with other engines, buckets and fingerprints."""

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType

from quern.functions import minwise


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def hash_bucket(c: Column, divisor: int) -> Column:
    """The first 32 bits of SHA-256 modulo divisor."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % divisor


def hash_unit(c: Column) -> Column:
    """The first 32 bits of SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


@pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; null for what isn't JSON."""

    def one(value):
        try:
            return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return values.map(one)


def simhash64(shingles: Column) -> Column:
    """64-bit SimHash (Charikar 2002) of an array of strings, every occurrence counted; null for an empty array."""
    powers = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)]

    def fold(hashes: Column) -> Column:
        votes = F.aggregate(hashes, F.array(*[F.lit(0)] * 64), lambda a, h: F.transform(a, lambda v, i: v + F.when(F.getbit(h, i) == 1, 1).otherwise(-1)))
        return F.aggregate(F.zip_with(votes, F.array(*powers), lambda v, p: F.when(v > 0, p).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return F.when(F.size(shingles) > 0, F.element_at(F.transform(F.array(F.transform(shingles, lambda s: F.xxhash64(s))), fold), 1))


def majority(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that most of the hashes of each text have; no text is without one."""
    first = np.cumsum(size) - size
    code = np.zeros(len(size), dtype=np.uint64)
    for bit in range(64 if len(size) else 0):
        votes = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first)
        code |= (2 * votes > size).astype(np.uint64) << np.uint64(bit)
    return code.view(np.int64)


_TOKEN = re.compile(r"\w+")


@pandas_udf(LongType())
def simhash_of_text(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of the runs of three words of a text, every occurrence counted; of a shorter text the hash of its words, or of
    its signs if it has none; null for a null text. A batch is hashed as one flat array and its votes are counted bit by bit."""
    known = minwise.WordHashes()
    out = np.full(len(texts), None, dtype=object)
    there = np.flatnonzero(texts.notna().to_numpy())
    for i in range(0, len(there), 256):
        part = there[i : i + 256]
        own = [texts.iloc[k].lower() for k in part]
        tokens = [_TOKEN.findall(t) or [" ".join(t.split()), ""] for t in own]
        out[part] = majority(*minwise.shingles(*minwise.flat(tokens, known), 3))
    return pd.Series(out, index=texts.index, dtype="Int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
