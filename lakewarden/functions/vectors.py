"""Vector and score expressions on ``array<double>`` columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    n = norm(a) + F.lit(1e-12)
    return F.transform(doubles(a), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-12))


def logistic(z: Column) -> Column:
    """Probability of a logit; the logit is clipped where the exponential would overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))


def softmax(v: Column) -> Column:
    shifted = F.transform(doubles(v), lambda x: F.exp(x - F.array_max(doubles(v))))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def rescaled(x: Column, floor: float, ceiling: float, top: float = 1.0) -> Column:
    """A similarity between floor and ceiling mapped to [0, top]."""
    return clip((x - F.lit(float(floor))) / F.lit(float(ceiling - floor))) * F.lit(float(top))


def decay(age_s: Column, half_life_s: float = 600.0) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(age_s, F.lit(0.0)) / F.lit(float(half_life_s)))


def classifier_risk(p: Column, flag: Column, block: Column, alone: Column, corroborated: Column) -> Column:
    """Piecewise risk of a classifier's probability: 0 below the flag threshold, 0.30-0.50 up to the block threshold, 0.60 above it
    without agreement of another detector, 0.85-1.0 with it or above the block-alone threshold."""
    rising = F.lit(0.30) + F.lit(0.20) * (p - flag) / F.greatest(block - flag, F.lit(1e-9))
    high = F.lit(0.85) + F.lit(0.15) * (p - block) / F.greatest(F.lit(1.0) - block, F.lit(1e-9))
    return F.when(p < flag, F.lit(0.0)).when(p < block, rising).when(corroborated | (p >= alone), clip(high)).otherwise(F.lit(0.60))


def entropy(token: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(token, "")
    chars = F.filter(chars, lambda c: c != "")
    n = F.size(chars).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.coalesce(-F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(p)), F.lit(0.0))
