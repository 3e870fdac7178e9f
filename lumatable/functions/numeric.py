"""Small numeric column helpers shared by the stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def clamp(v: Column, lo, hi) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v))


def clamp01(v: Column) -> Column:
    return clamp(v, 0.0, 1.0)


def half_up(v: Column) -> Column:
    """Nearest integer with halves going up, as an INT column."""
    return F.floor(v + 0.5).cast("int")


def smoothstep(lo, hi, v: Column) -> Column:
    """Smooth rise from 0 at ``lo`` to 1 at ``hi``; a step where the two coincide."""
    span = hi - lo
    step = (v >= hi).cast("double")
    t = F.when(span == 0, step).otherwise(clamp01(F.try_divide(v - lo, span)))
    return t * t * (3.0 - 2.0 * t)


def length2(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def any_of(preds) -> Column:
    return reduce(lambda p, q: p | q, preds)


def all_of(preds) -> Column:
    return reduce(lambda p, q: p & q, preds)


def total(cols) -> Column:
    return reduce(lambda p, q: p + q, cols)


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def normalize_angle(v: Column) -> Column:
    """Wrap degrees into [-180, 180)."""
    return F.pmod(v + 180.0, F.lit(360.0)) - 180.0
