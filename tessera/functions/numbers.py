"""Arithmetic rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.constants import DEAD_BAND


def tidy(c: Column, places: int) -> Column:
    """Round for output; the first pass removes float noise so ties go one way."""
    return F.round(F.round(c, 12), places)


def ratio(n: Column, d: Column) -> Column:
    """Null on a zero denominator, never NaN."""
    return tidy(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), 6)


def clip01(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def saturate(count: Column, cap: Column) -> Column:
    return F.least(count, cap).cast("double") / cap.cast("double")


def blend(count: Column, cap: Column, specificity: Column, share: Column, rest: Column) -> Column:
    return clip01(share * saturate(count, cap) + rest * clip01(specificity))


def logistic(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def direction(c: Column) -> Column:
    return (
        F.when(c > DEAD_BAND, "increases").when(c < -DEAD_BAND, "decreases").otherwise("neutral")
    )
