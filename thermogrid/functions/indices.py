"""Composite indices of the feature table. City-wide figures arrive as columns, usually scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from thermogrid import constants as K
from thermogrid.functions.numeric import _c, clip01, min_max_scale, null_tolerant_min

__all__ = [
    "proximity", "impervious_surface_ratio", "green_to_built_ratio", "cooling_distance_index", "road_exposure_index",
    "vegetation_cooling_index", "terrain_exposure_index", "heat_vulnerability_index",
]


def _zero(value) -> Column:
    return F.coalesce(_c(value), F.lit(0.0))


def proximity(distance_m, reference_m: float = K.PROXIMITY_REF_M) -> Column:
    """1 at the feature, towards 0 far away; no known distance gives 0."""
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + _c(distance_m) / F.lit(reference_m)), F.lit(0.0))


def impervious_surface_ratio(built_pct, bare_pct) -> Column:
    return clip01((_zero(built_pct) + _zero(bare_pct)) / F.lit(100.0))


def green_to_built_ratio(vegetation_pct, built_pct) -> Column:
    return (_zero(vegetation_pct) + F.lit(K.RATIO_EPS)) / (_zero(built_pct) + F.lit(K.RATIO_EPS))


def cooling_distance_index(park_m, water_m, green_space_pct) -> Column:
    near = proximity(null_tolerant_min(park_m, water_m))
    return clip01(F.lit(0.5) * near + F.lit(0.5) * (_zero(green_space_pct) / F.lit(100.0)))


def road_exposure_index(road_density, major_road_m, low: Column, high: Column) -> Column:
    """The literal rule: the second half rises with the distance to a major road."""
    dense = min_max_scale(_zero(road_density), low, high)
    return clip01(F.lit(0.5) * dense + F.lit(0.5) * (F.lit(1.0) - proximity(major_road_m)))


def _ndvi_scaled(ndvi, p2: Column, p98: Column, flat: float) -> Column:
    n = _c(ndvi)
    return F.when(p98 - p2 > F.lit(1e-9), (n - p2) / (p98 - p2)).otherwise(n * F.lit(0.0) + F.lit(flat))


def vegetation_cooling_index(ndvi, green_cover_pct, p2: Column, p98: Column) -> Column:
    return clip01(clip01(_ndvi_scaled(ndvi, p2, p98, 0.0)) * (_zero(green_cover_pct) / F.lit(100.0)))


def terrain_exposure_index(slope, low: Column, high: Column) -> Column:
    return clip01(min_max_scale(_zero(slope), low, high))


def heat_vulnerability_index(
    impervious, green_space_pct, building_density, road_exposure, ndvi,
    density_low: Column, density_high: Column, p2: Column, p98: Column,
) -> Column:
    w = K.HVI_WEIGHTS
    low_green = F.lit(1.0) - _zero(green_space_pct) / F.lit(100.0)
    dense = min_max_scale(_zero(building_density), density_low, density_high)
    low_ndvi = clip01(F.lit(1.0) - _ndvi_scaled(ndvi, p2, p98, 0.5))
    return clip01(
        F.lit(w["impervious"]) * _c(impervious)
        + F.lit(w["low_green"]) * low_green
        + F.lit(w["building_density"]) * dense
        + F.lit(w["road_exposure"]) * _c(road_exposure)
        + F.lit(w["low_ndvi"]) * low_ndvi
    )
