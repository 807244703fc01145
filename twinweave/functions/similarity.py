"""Similarity kernels: column expressions where Spark has the operations, Arrow
functions where it has not (the Ratcliff-Obershelp ratio)."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIGH, MODERATE = 0.75, 0.40
# Wording of the verdicts.
VERDICTS = (
    "High similarity — likely copied or derived",
    "Moderate similarity — possible reuse or inspiration",
    "Low similarity — likely independent",
)


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio; null counts as the empty string."""
    a, b = a or "", b or ""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def ratio_udf(a, b):
    import pandas as pd

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_possible(a: Column, b: Column, threshold: float) -> Column:
    """False only where the lengths alone keep the ratio below the threshold.

    The ratio is at most 2 min / (l1 + l2); this native bound belongs into join
    conditions, so that the Arrow function sees fewer pairs.
    """
    x, y = F.length(a), F.length(b)
    return 2.0 * F.least(x, y) >= threshold * (x + y)


def length_band(text: Column, threshold: float) -> Column:
    """Number of a band of lengths: texts whose ratio may reach the threshold are
    in the same or in neighbouring bands (the shorter one is at least
    threshold / (2 - threshold) of the longer); empty texts have one of their own."""
    step = math.log((2 - threshold) / threshold)
    return F.coalesce(F.floor(F.log(F.nullif(F.length(text), F.lit(0)).cast("double")) / step), F.lit(-10)).cast("int")


def fuzzy_string(a: Column, b: Column, score: Column) -> Column:
    """Both empty 1, one empty 0, else the given ratio."""
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(score).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two count maps; 1 if both are empty."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    zero = F.lit(0).cast("long")

    def total(pick):
        return F.aggregate(keys, zero, lambda s, k: s + pick(F.coalesce(a[k].cast("long"), zero), F.coalesce(b[k].cast("long"), zero)))

    return F.when(F.size(keys) == 0, F.lit(1.0)).otherwise(total(F.least) / total(F.greatest)).cast("double")


def hybrid(a: Column, b: Column) -> Column:
    """Mean of the multiset and the set Jaccard similarity of two count maps."""
    return 0.5 * multiset_jaccard(a, b) + 0.5 * jaccard(F.map_keys(a), F.map_keys(b))


def verdict(score: Column) -> Column:
    high, moderate, low = map(F.lit, VERDICTS)
    return F.when(score >= HIGH, high).when(score >= MODERATE, moderate).otherwise(low)


def verdict_level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MODERATE, "moderate").otherwise("low")


def py_round(value: float | None, digits: int) -> float | None:
    return None if value is None else round(value, digits)


@F.pandas_udf(T.DoubleType())
def round2(s):
    """Rounding of the binary value to two places, as reports show it."""
    return s.map(lambda v: round(v, 2), na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def round3(s):
    return s.map(lambda v: round(v, 3), na_action="ignore").astype("float64")
