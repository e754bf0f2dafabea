"""Risk levels and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from thermogrid.functions.numeric import _c

__all__ = ["class_risk", "vegetation_risk", "density_risk", "risk_score", "risk_band"]


def _risk(level: str | None, label: Column) -> Column:
    tone = "na" if level is None else level.lower()
    return F.struct(F.lit(level).cast("string").alias("level"), label.alias("label"), F.lit(tone).alias("tone"))


def _missing() -> Column:
    return _risk(None, F.lit("Unavailable"))


def class_risk(label, moderate: list[str], high: list[str]) -> Column:
    c = _c(label)
    return (
        F.when(c.isNull(), _missing())
        .when(c.isin(high), _risk("High", c))
        .when(c.isin(moderate), _risk("Moderate", c))
        .otherwise(_risk("Low", c))
    )


def vegetation_risk(ndvi, green_cover_pct) -> Column:
    """NDVI decides; green cover stands in where NDVI is missing."""
    n, g = _c(ndvi), _c(green_cover_pct)
    by_ndvi = F.concat(F.lit("NDVI "), F.format_string("%.2f", n))
    by_green = F.concat(F.lit("Green cover "), F.format_string("%.0f", g), F.lit("%"))
    return (
        F.when(n < 0.2, _risk("High", by_ndvi))
        .when(n < 0.4, _risk("Moderate", by_ndvi))
        .when(n.isNotNull(), _risk("Low", by_ndvi))
        .when(g < 20, _risk("High", by_green))
        .when(g < 40, _risk("Moderate", by_green))
        .when(g.isNotNull(), _risk("Low", by_green))
        .otherwise(_missing())
    )


def density_risk(building_coverage_pct) -> Column:
    b = _c(building_coverage_pct)
    text = F.concat(F.format_string("%.0f", b), F.lit("% built"))
    return (
        F.when(b.isNull(), _missing())
        .when(b >= 60, _risk("High", text))
        .when(b >= 30, _risk("Moderate", text))
        .otherwise(_risk("Low", text))
    )


def risk_score(*levels) -> Column:
    """Equal-weight mean of level scores: High 1, Moderate 0.5, anything else 0."""
    total = F.lit(0.0)
    for level in levels:
        lv = _c(level)
        total = total + F.when(lv == "High", F.lit(1.0)).when(lv == "Moderate", F.lit(0.5)).otherwise(F.lit(0.0))
    return total / F.lit(float(len(levels)))


def risk_band(score) -> Column:
    s = _c(score)
    return F.when(s >= 0.66, F.lit("High")).when(s >= 0.33, F.lit("Moderate")).otherwise(F.lit("Low"))
