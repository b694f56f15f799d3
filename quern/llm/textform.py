"""Text forms that several operators compare by."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_WORD = re.compile(r"[^\W_]+")


def fold(value: str | None) -> str | None:
    """Without differences of letter case, spacing and Unicode form; null stays null."""
    if value is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", value).casefold()).replace("​", "").replace("﻿", "").split())


def words(value: str | None) -> list[str]:
    """Words without letter case, punctuation, spacing and Unicode form."""
    return _WORD.findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", value or "").casefold()))


@pandas_udf(StringType())
def _folded(values: pd.Series) -> pd.Series:
    distinct = {v: fold(v) for v in values.dropna().unique()}
    return values.map(distinct).astype(object).where(values.notna(), None)


def folded(c: Column) -> Column:
    """fold() on a column. Values of plain ASCII are folded in the JVM; Python gets nulls for them."""
    ascii_only = c.rlike(r"^[\x00-\x7f]*$")
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\s\x1c-\x1f]+", " "))
    return F.when(ascii_only, plain).otherwise(_folded(F.when(~ascii_only, c)))
