"""Scores of claims and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results must agree on.
HALF_LIFE_DAYS = 30.0
SATURATION = 20
DAILY_DECAY = 0.995
STEP = 0.05
RRF_K = 60
CONFIDENCE = ("unknown", "low", "medium", "high")


def age_days(as_of: Column, then: Column) -> Column:
    """Days from then to as_of with fractions; 0 if later or null. Both without a zone, or both with one."""
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0.0), seconds / F.lit(86400e6)), F.lit(0.0))


def recency(age: Column) -> Column:
    return F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)


def salience(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(count) / F.log1p(F.lit(SATURATION)))


def decayed(strength: Column, days: Column, floor: Column) -> Column:
    """Strength after whole days without support, never below the floor."""
    return F.greatest(floor, strength * F.pow(F.lit(DAILY_DECAY), days))


def reinforced(first: float, times: Column) -> Column:
    """Strength after a claim was seen so many times."""
    return F.least(F.lit(1.0), F.lit(first) + STEP * (times - 1))


def rrf(rank: Column, weight: float) -> Column:
    return F.lit(weight) / (RRF_K + rank)


def idf(total: Column, df: Column) -> Column:
    return F.log((total + 1) / (df + 1)) + 1


def confidence_rank(x: Column) -> Column:
    """Place of a confidence in its order; anything else is lowest."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(c) for c in CONFIDENCE)), x), F.lit(0)) - 1, F.lit(0)).cast("int")


#: Weights of a recall score's parts, without a query, with one, and with one and semantic likenesses.
PARTS = ("strength", "recency", "salience", "relevance", "semantic")
RECALL_WEIGHTS = {"plain": (9 / 17, 5 / 17, 3 / 17, 0.0, 0.0), "lexical": (0.45, 0.25, 0.15, 0.15, 0.0), "semantic": (0.45, 0.25, 0.15, 0.05, 0.10)}


def recall_weights(has_query: bool, has_semantics: bool) -> dict[str, float]:
    """The row of weights for a recall; parts without weight are left out."""
    row = RECALL_WEIGHTS[("semantic" if has_semantics else "lexical") if has_query else "plain"]
    return {part: weight for part, weight in zip(PARTS, row) if weight}


def recall_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum, to six decimals."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + parts[name] * weight
    return F.round(total, 6)
