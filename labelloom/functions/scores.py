"""Expressions over per-class score arrays stored by any model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.text import bind


def argmax_index(scores: Column) -> Column:
    """0-based index of the largest score; the lowest index wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    """Probabilities from scores, shifted by the maximum so that ``exp`` cannot overflow."""

    def normalised(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(exps, lambda x: x / t))

    def shifted(values: Column) -> Column:
        return bind(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))

    return bind(bind(scores.cast("array<double>"), shifted), normalised)


def in_top_k(scores: Column, true_index: Column, k: int) -> Column:
    """Whether fewer than ``k`` scores exceed the true one; a tie counts as a hit.

    Null if the true index is null or names no score, or if its score is null. NaN is larger than any number, as in
    all comparisons of Spark; null scores exceed nothing.
    """
    return bind(
        F.get(scores, true_index),
        lambda mine: F.when(mine.isNotNull(), F.size(F.filter(scores, lambda s: s > mine)) < k),
    )
