"""Rounding, guards and classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

__all__ = [
    "round_even", "round_half_up", "finite", "to_number", "blank_to_null", "positive_or_null",
    "safe_divide", "clip", "clip01", "classify_breaks", "label_below", "null_tolerant_min",
    "min_max_scale", "z_score", "flag_to_null",
]


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def round_even(value, digits: int = 0) -> Column:
    """Round half to even, on the scaled double."""
    scale = 10.0**digits
    return F.rint(_c(value) * F.lit(scale)) / F.lit(scale)


def round_half_up(value, digits: int = 0) -> Column:
    """Round half up (towards plus infinity), the browser rule."""
    scale = 10.0**digits
    return F.floor(_c(value) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def finite(value) -> Column:
    """Null unless the double is finite."""
    v = _c(value)
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def to_number(value) -> Column:
    """Parse to double; text that is no number, NaN and infinity become null."""
    return finite(_c(value).try_cast("double"))


def blank_to_null(value) -> Column:
    return F.nullif(F.trim(_c(value)), F.lit(""))


def flag_to_null(value, flag: float) -> Column:
    v = _c(value)
    return F.when(v != F.lit(flag), v)


def positive_or_null(value) -> Column:
    v = _c(value)
    return F.when(v > 0, v)


def safe_divide(numerator, denominator, fill: float | None = None) -> Column:
    d = _c(denominator)
    otherwise = F.lit(fill).cast("double")
    return F.when(d != 0, _c(numerator) / d).otherwise(otherwise)


def clip(value, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to [low, high]; null stays null (greatest and least would skip it)."""
    v = out = _c(value)
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return out if out is v else F.when(v.isNotNull(), out)


def clip01(value) -> Column:
    return clip(value, 0.0, 1.0)


def classify_breaks(value, breaks: Sequence) -> Column:
    """Class 1..n+1; a value equal to a break belongs to the upper class; missing is 0."""
    v = _c(value)
    steps = [(v >= (b if isinstance(b, Column) else F.lit(float(b)))).cast("int") for b in breaks]
    total = F.lit(1)
    for step in steps:
        total = total + step
    return F.when(v.isNull(), F.lit(0)).otherwise(total)


def label_below(value, thresholds: Sequence[tuple[str, float]], last: str, inclusive: bool = False) -> Column:
    """First label whose threshold lies above (or, inclusive, at or above) the value."""
    v = _c(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for label, limit in thresholds:
        out = out.when(v <= F.lit(float(limit)) if inclusive else v < F.lit(float(limit)), F.lit(label))
    return out.otherwise(F.lit(last))


def null_tolerant_min(*values) -> Column:
    return F.least(*[_c(v) for v in values])


def min_max_scale(value, low: Column, high: Column) -> Column:
    """0..1 scaling; a constant or empty column gives 0.5."""
    v = _c(value)
    flat = low.isNull() | (high - low <= F.lit(1e-12))
    return F.when(flat, F.lit(0.5)).otherwise((v - low) / (high - low))


def z_score(value, mean: Column, std: Column) -> Column:
    """Z-score with the population deviation; a constant column gives 0."""
    v = _c(value)
    return F.when(std > 0, (v - mean) / std).otherwise(v * F.lit(0.0))
