"""Declarative rules over the columns of a row: a table of rules becomes one column expression."""

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    field: str
    op: str
    value: object
    effect: str


OPS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "prefix": lambda c, v: c.startswith(v),
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
    "has": lambda c, v: F.array_contains(c, v),
    "exists": lambda c, v: c.isNotNull() == F.lit(bool(v)),
}


def matches(rule: Rule) -> Column:
    """Whether a row meets a rule; a null is met by no rule but exists."""
    return F.coalesce(OPS[rule.op](F.col(rule.field), rule.value), F.lit(False))


def first_match(rules: list[Rule], default: str) -> Column:
    """struct(effect, rule) of the first rule that a row meets."""
    out = F.struct(F.lit(default).alias("effect"), F.lit(None).cast("string").alias("rule"))
    for r in reversed(rules):
        out = F.when(matches(r), F.struct(F.lit(r.effect).alias("effect"), F.lit(r.name).alias("rule"))).otherwise(out)
    return out


def severest(rules: list[Rule], order: list[str], default: str) -> Column:
    """The effect that comes first in order among those of all rules that a row meets."""
    met = F.array(*[F.when(matches(r), F.lit(order.index(r.effect))) for r in rules])
    least = F.array_min(met)
    return F.when(least.isNull(), default).otherwise(F.element_at(F.array(*map(F.lit, order)), least + 1))


def admitted(names: Column, allowed: list[str], forbidden: str) -> Column:
    """Whether there are names, all of them are allowed, and none has the forbidden shape, which wins over the list."""
    return F.coalesce((F.size(names) > 0) & F.forall(names, lambda x: x.isin(*allowed) & ~x.rlike(forbidden)), F.lit(False))
