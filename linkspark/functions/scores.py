"""Numbers: clamps, overlaps, saturation weights and decays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def scaled(x: Column, norm: float) -> Column:
    return clamp(x / F.lit(float(norm))) if norm else F.lit(0.0)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column) -> Column:
    """The share of a term's weight that its frequency earns in a text of some length."""
    mean = F.when(average > 0, average).otherwise(1.0)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Common elements by the longer list; 0 if either is empty or null."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def entropy_share(counts: Column) -> Column:
    """Entropy of an array of counts by its maximum; 0 for fewer than two kinds."""
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, (x / total) * F.log(x / total)).otherwise(0.0))
    return F.when(F.size(counts) > 1, bits / F.log(F.size(counts).cast("double"))).otherwise(0.0)


def iso_instant(text: Column) -> Column:
    """ISO dates and times, those without zone in UTC; null for others."""
    clean = F.regexp_replace(text, r"[Zz]\z", "+00:00")
    clean = F.regexp_replace(clean, r"([T ]\d\d:\d\d)([+-]|\z)", "$1:00$2")
    zoned = F.when(clean.rlike(r"[+-]\d\d:?\d\d\z") | ~clean.rlike(r"\d\d:\d\d"), clean).otherwise(F.concat(clean, F.lit("+00:00")))
    shaped = clean.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d([.]\d+)?)?([+-]\d\d:?\d\d)?)?\z")
    basic = F.when(clean.rlike(r"^\d{8}\z"), F.try_to_timestamp(F.concat(clean, F.lit("+00")), F.lit("yyyyMMddx")))
    day = F.when(clean.rlike(r"^\d{4}-\d\d-\d\d\z"), F.try_to_timestamp(F.concat(clean, F.lit("T00:00:00+00:00"))))
    return F.coalesce(basic, day, F.when(shaped, F.try_to_timestamp(zoned)))


def freshness(source: Column, target: Column, half_life: float) -> Column:
    """Falls with the days between two instants, counted by flooring target to source; 0.4 for an undated target."""
    days = F.abs(F.floor((F.unix_micros(source) - F.unix_micros(target)) / F.lit(86_400_000_000)))
    return F.when(target.isNull(), 0.4).otherwise(clamp(F.greatest(F.lit(0.1), 1 - days / F.lit(2.0 * half_life))))


def link_budget(n_words: Column, base: int, cap: int) -> Column:
    return F.least(base + F.floor(F.greatest(n_words, F.lit(1)) / 500), F.lit(cap)).cast("int")
