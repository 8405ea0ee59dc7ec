"""Numeric column expressions shared by the metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A threshold above every probability: everything is reviewed.
REVIEW_ALL = 1.0000000001


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; null when the denominator is 0 or null."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom)


def count_if(condition: Column) -> Column:
    """How many rows meet the condition (0 for no rows)."""
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def finite(x: Column) -> Column:
    """Whether a nullable double is an ordinary number (never null)."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logistic_loss(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that never overflows."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score bounds of a proportion, clipped to [0, 1]; null for no trials."""
    n = F.when(total > 0, total.cast("double"))
    p = successes.cast("double") / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low, high = centre - half, centre + half
    return (F.when(n.isNotNull(), F.greatest(F.lit(0.0), low)),
            F.when(n.isNotNull(), F.least(F.lit(1.0), high)))


def equal_width_bin(p: Column, bins: int) -> Column:
    """Index of the equal-width bin of ``p`` in [0, 1], comparing with ``i / bins`` as floats.

    ``floor(p * bins)`` differs from this at some edges. The last bin is closed.
    """
    index = F.when(p < 0, F.lit(None).cast("int"))
    for i in range(bins - 1):
        index = index.when(p < (i + 1) / bins, i)
    return index.when(p <= 1, bins - 1)
