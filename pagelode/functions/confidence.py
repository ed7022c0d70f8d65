"""Confidence scores: levels, weighted means, and scores of searches, answers and ensembles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

REJECTED_BELOW, REVIEW_BELOW, REFINE_BELOW, LOW_FIELD = 0.5, 0.8, 0.8, 0.7


def level(confidence: Column) -> Column:
    return F.when(confidence < REJECTED_BELOW, "rejected").when(confidence < REVIEW_BELOW, "review").otherwise("accepted")


def needs_refinement(overall: Column) -> Column:
    return overall < REFINE_BELOW


def low_fields(breakdown: Column, least: float = LOW_FIELD) -> Column:
    """Names whose score lies below ``least``, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(breakdown, lambda _, v: v < least)))


def weighted(scores: Mapping[str, tuple[Column, float]]) -> Column:
    """The mean by weight of named scores."""
    total = sum(w for _, w in scores.values())
    return sum((s * w for s, w in scores.values()), F.lit(0.0)) / total


def last_weight_mean(scores: list[tuple[Column, float]]) -> Column:
    """The sum of scores times the last weight over their number: what a component list that forgets its weights gives."""
    return sum((s for s, _ in scores), F.lit(0.0)) * scores[-1][1] / len(scores)


def search(scores: Column) -> Column:
    """Of an array of top scores: mean * .7 + consistency * .3, where consistency is 1 less the variance (a single score: .5)."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    spread = F.aggregate(F.transform(scores, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    steady = F.when(n == 1, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - spread))
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean * 0.7 + steady * 0.3))).otherwise(0.0)


def agreement(distinct: Column, answers: Column) -> Column:
    """Of one field over several answers: 1 over the number of different values."""
    return F.when(answers > 0, 1.0 / F.nullif(distinct, F.lit(0)))


def schema_errors(count: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.1 * count)


def pass_ratio(passed: Column, rules: Column) -> Column:
    return F.coalesce(passed / F.nullif(rules, F.lit(0)), F.lit(1.0))


def completeness(values: list[Column]) -> Column:
    """The share of values that are there and not blank."""
    filled = [F.when(v.isNotNull() & (F.trim(v.cast("string")) != ""), 1).otherwise(0) for v in values]
    return sum(filled, F.lit(0)) / len(filled)


def response_quality(parsed: Column, values: list[Column], field_scores: Column) -> Column:
    """The mean of completeness, field quality and parsability of an answer."""
    return (completeness(values) + field_scores + F.when(parsed, 1.0).otherwise(0.0)) / 3


def discovery(search_score: Column, answer_score: Column) -> Column:
    return 0.4 * search_score + 0.6 * answer_score


def fields(search_score: Column, answer_score: Column, filled: Column) -> Column:
    return 0.3 * search_score + 0.5 * answer_score + 0.2 * filled
