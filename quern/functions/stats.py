"""Statistical column expressions (JVM-side)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval (1927); (0, 1) without observations."""
    p, z2 = successes / n, z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (centre - spread) / (1 + z2 / n), (centre + spread) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(high, F.lit(1.0))).otherwise(1.0)


def quality(feedback: Column, verifier: Column) -> Column:
    """What a person said of a run, else what the verifier said."""
    return F.coalesce(feedback, verifier)


def complexity_bucket(c: Column) -> Column:
    return F.when(c < 0.3, "low").when(c < 0.6, "medium").when(c < 0.8, "high").otherwise("extreme")


def difficulty_bucket(c: Column) -> Column:
    return F.when(c < 0.34, "easy").when(c < 0.67, "medium").otherwise("hard")


def tier(score: Column, proven: Column) -> Column:
    return F.when((score > 0.92) & proven, "gold").when(score >= 0.80, "silver").when(score >= 0.60, "bronze").otherwise("raw")


def smoothed_rate(successes: Column, n: Column) -> Column:
    """Laplace's rule of succession."""
    return (successes + 1) / (n + 2)


def decay(confidence: Column, rate: Column, hours: Column) -> Column:
    return confidence * F.exp(-rate * hours)


def entropy(probabilities: Column) -> Column:
    """Nats of an array of probabilities."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    peak = F.array_max(values)
    e = F.transform(values, lambda x: F.exp((x - peak) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def noisy_or(strengths: Column) -> Column:
    """1 minus the product of what each strength leaves open; a strength counts as 0.999 at most."""
    return 1 - F.aggregate(strengths, F.lit(1.0), lambda a, s: a * (1 - F.least(s, F.lit(0.999))))


def noisy_or_of(strength: Column) -> Column:
    """noisy_or() as an aggregate: nothing is collected."""
    return 1 - F.exp(F.sum(F.log1p(-F.least(strength, F.lit(0.999)))))
