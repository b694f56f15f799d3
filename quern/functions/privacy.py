"""Personal data and credentials in texts: named findings in the JVM, and stand-ins that keep who is who within a record."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Shapes that Java, RE2 and Python read alike; PERSON needs a form of address ahead of the name.
PATTERNS = {
    "credential": r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:sk|pk|ghp|glpat|xox[abp])[_-][A-Za-z0-9_-]{16,}|\bAKIA[0-9A-Z]{16}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b",
    "card": r"\b[0-9]{4}(?:[ -][0-9]{4}){3}\b",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}\b",
    "national_id": r"\b[0-9]{8}-?[A-Z]\b",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Sra?|Herr|Frau|Mme|Don|Sig)\.? [A-ZÀ-Ý][a-zà-ÿ]+(?: [A-ZÀ-Ý][a-zà-ÿ]+)+",
}


def findings(text: Column) -> Column:
    """Names of the patterns that a text has, in their order; empty for a null text."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text.rlike(p), F.lit(False)), F.lit(name)) for name, p in PATTERNS.items()]))


def chunks(text: Column, stride: int = 50_000, overlap: int = 512) -> Column:
    """Pieces of a text that overlap; a finding of up to overlap characters lies wholly in one of them."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / stride).cast("int")), lambda i: F.substring(text, i * stride + 1, F.lit(stride + overlap)))


def chunked_findings(text: Column, stride: int = 50_000, overlap: int = 512) -> Column:
    """findings() of a very long text by pieces, so that no expression runs over more than a piece at once."""
    each = F.flatten(F.transform(chunks(F.coalesce(text, F.lit("")), stride, overlap), findings))
    return F.filter(F.array(*map(F.lit, PATTERNS)), lambda name: F.array_contains(each, name))


_ANY = re.compile("|".join(f"(?P<{name}>{p})" for name, p in PATTERNS.items()))


def stand_ins(fields: list[str | None]) -> list[str | None]:
    """The fields of a record with <KIND_k> in place of what was found; the same value has the same stand-in in all fields, and
    each kind counts from 1 in the order in which its values appear."""
    known: dict[tuple[str, str], str] = {}
    counts: dict[str, int] = {}

    def one(m: re.Match) -> str:
        kind, value = m.lastgroup, " ".join(m[0].split())
        if (kind, value) not in known:
            counts[kind] = counts.get(kind, 0) + 1
            known[kind, value] = f"<{kind.upper()}_{counts[kind]}>"
        return known[kind, value]

    return [None if f is None else _ANY.sub(one, f) for f in fields]


@pandas_udf(StringType())
def pseudonymized(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else stand_ins([v])[0])


def pseudonymized_all(*columns: Column) -> Column:
    """An array of the columns of a row, pseudonymized as one record."""

    @pandas_udf("array<string>")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([stand_ins([None if x is None else str(x) for x in row]) for row in zip(*series)], dtype=object)

    return run(*columns)
