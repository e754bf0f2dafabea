"""Air quality: sub-indices, composite index and categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from thermogrid import constants as K
from thermogrid.functions.numeric import _c, label_below

__all__ = ["aqi_subindex", "composite_aqi", "aqi_category", "aqi_category_code", "column_to_surface"]


def aqi_subindex(concentration, pollutant: str, open_top: bool = False) -> Column:
    """Linear inside each closed band; a value between two bands gives null.

    The top band ends at twice its start. A value above that has the top index, so the worst pollutant is never lost;
    with `open_top` it gives null, as the literal rule has it.
    """
    c = _c(concentration)
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for low, high, ilow, ihigh in K.AQI_BANDS[pollutant]:
        top = float(high) if high is not None else low * 2.0
        low = float(low)
        share = (c - F.lit(low)) / F.lit(top - low)
        out = out.when((c >= F.lit(low)) & (c <= F.lit(top)), F.lit(float(ilow)) + F.lit(float(ihigh - ilow)) * share)
        if high is None and not open_top:
            out = out.when(c > F.lit(top), F.lit(float(ihigh)))
    return out


def composite_aqi(columns: dict[str, str], open_top: bool = False) -> Column:
    """Largest sub-index over the pollutants given; carbon monoxide is converted to mg/m3 first."""
    parts = [
        aqi_subindex(F.col(c) / F.lit(1000.0) if p == "co" else F.col(c), p, open_top) for p, c in columns.items()
    ]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def aqi_category(aqi) -> Column:
    return label_below(aqi, K.AQI_UPPER_BOUNDS, "Severe", inclusive=True)


def aqi_category_code(aqi) -> Column:
    """1..6 by lower bound; missing is 0."""
    a = _c(aqi)
    total = F.lit(0)
    for _, start in K.AQI_LOWER_BOUNDS:
        total = total + (a >= F.lit(float(start))).cast("int")
    return F.when(a.isNull(), F.lit(0)).otherwise(total)


def column_to_surface(column_density, gas: str) -> Column:
    """mol/m2 in a column to ug/m3 near the ground."""
    return _c(column_density) / F.lit(K.BOUNDARY_LAYER_M) * F.lit(K.MOLAR_MASS[gas]) * F.lit(1e6)
