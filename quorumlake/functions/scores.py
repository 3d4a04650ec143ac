"""Scores and stages of papers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The thresholds of the stages.
UNDER_REVIEW, PROMOTED, PUBLISHED = 6.5, 7.5, 8.0


def round2(x: Column) -> Column:
    """Two decimals, halves up, of the binary product (not of the decimal value)."""
    return F.floor(x * 100.0 + 0.5) / 100.0


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null, NaN and infinities give the lower bound."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def community_score(e: Column, c: Column, r: Column) -> Column:
    n = e + c + r
    return F.when(n == 0, F.lit(0.0)).otherwise((e * 10.0 + c * 4.0) / n)


def combined_score(rigor: Column, conf: Column, community: Column, votes: Column) -> Column:
    rigor, ai = F.coalesce(rigor, F.lit(0.0)), F.coalesce(conf, F.lit(0.0)) * 10.0
    few = F.lit(0.55) * rigor + F.lit(0.35) * ai + F.lit(0.1) * community
    return F.when(votes < 3, few).otherwise(F.lit(0.4) * rigor + F.lit(0.25) * ai + F.lit(0.35) * community)


def stage(combined: Column, rigor: Column, e: Column, c: Column, r: Column) -> Column:
    n = e + c + r
    return (
        F.when((combined >= PUBLISHED) & (e >= 5) & (e > r * 2), "published")
        .when((combined >= PROMOTED) & (n >= 3) & (e >= r), "promoted")
        .when((combined >= UNDER_REVIEW) | (n >= 1) | (F.coalesce(rigor, F.lit(0.0)) >= UNDER_REVIEW), "under_review")
        .otherwise("draft")
    )


def progress(score: Column, stage_: Column) -> Column:
    """Per cent of the way to the next stage's threshold."""
    following = F.when(stage_ == "draft", UNDER_REVIEW).when(stage_ == "under_review", PROMOTED).otherwise(PUBLISHED)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score / following * 100.0))


def fallback_score(length: Column, references: Column) -> Column:
    """What a paper gets where no report could be made."""
    return clamp(F.lit(4.0) + F.log10(F.greatest(length, F.lit(1)).cast("double")) + F.least(references, F.lit(6)) * 0.3, 1.0, 9.0)


def thresholds() -> Column:
    """The thresholds of the stages, as a constant column."""
    return F.struct(F.lit(UNDER_REVIEW).alias("under_review"), F.lit(PROMOTED).alias("promoted"), F.lit(PUBLISHED).alias("published"))
