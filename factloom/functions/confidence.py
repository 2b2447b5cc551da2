"""Ways to combine confidences, as Column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def noisy_and(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * clamp(x))


def noisy_or(values: Column) -> Column:
    return 1 - F.aggregate(values, F.lit(1.0), lambda a, x: a * (1 - clamp(x)))


def min_confidence(values: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(values, clamp)), F.lit(1.0))


def derive_confidence(values: Column, mode: str | Callable[[Column], Column] = "product") -> Column:
    """``product``, ``min``, ``noisy_or`` or a function of the array."""
    if callable(mode):
        return mode(values)
    ways = {"product": noisy_and, "min": min_confidence, "noisy_or": noisy_or}
    if mode not in ways:
        raise ValueError(f"unknown confidence mode: {mode}")
    return ways[mode](values)


def merge_confidence(values: Column, mode: str = "max") -> Column:
    ways = {"max": F.array_max, "min": F.array_min, "noisy_or": noisy_or}
    if mode not in ways:
        raise ValueError(f"unknown merge mode: {mode}")
    return ways[mode](values)


def noisy_or_agg(column: Column) -> Column:
    """The same over the rows of a group; partial products travel, not the values."""
    return 1 - F.product(1 - clamp(column))


def theme_confidence(frequency: Column, most: Column) -> Column:
    return F.when((most <= 1) | (frequency <= 0), 1.0).otherwise(0.5 + 0.5 * F.log(frequency) / F.log(most))
