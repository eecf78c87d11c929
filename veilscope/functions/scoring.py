"""Expressions that score a prediction against answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let
from .text import normalize, strip

#: What stands for a confidence that is no number (a fixed value).
NOT_FINITE = -100.0


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize(prediction) == normalize(gold)).cast("double")


def plain_match(prediction: Column, gold: Column) -> Column:
    """Equal but for case, without any other normalisation."""
    return (F.lower(F.coalesce(prediction, F.lit(""))) == F.lower(F.coalesce(gold, F.lit("")))).cast("double")


def token_f1(prediction: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall over words as multisets; both empty: 1, one of them: 0.

    A shared word counts as often as in the side that has it less often."""
    words = lambda c: F.filter(F.split(normalize(c), " "), lambda w: w != "")
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))

    def score(v: Column) -> Column:
        p, g = v["p"], v["g"]
        overlap = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda n, w: n + F.least(times(p, w), times(g, w)))
        both = F.size(p) + F.size(g)
        return F.when(both == 0, 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * overlap / both)

    return let(F.struct(words(prediction).alias("p"), words(gold).alias("g")), score)


def best(score, prediction: Column, answers: Column) -> Column:
    """The highest score over answers that aren't blank; over an empty one if all are."""
    full = F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda a: strip(a) != "")
    return F.array_max(F.transform(F.when(F.size(full) > 0, full).otherwise(F.array(F.lit(""))), lambda a: score(prediction, a)))


def sequence_confidence(log_probabilities: Column, tokens: Column, end: int) -> Column:
    """Mean log probability up to the end token (all if it is missing); 0 without any, NOT_FINITE if it isn't finite."""
    stop = F.array_position(tokens, end)
    used = F.slice(log_probabilities, F.lit(1), F.when(stop > 0, stop).otherwise(F.greatest(F.size(log_probabilities), F.lit(1))).cast("int"))
    mean = F.aggregate(used, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(used), F.lit(1))
    return F.when(F.isnan(mean) | (F.abs(mean) == float("inf")), NOT_FINITE).otherwise(F.coalesce(mean, F.lit(NOT_FINITE)))
