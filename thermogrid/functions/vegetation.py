"""Reflectance, NDVI and the classes derived from it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from thermogrid import constants as K
from thermogrid.functions.numeric import _c, classify_breaks, clip

__all__ = ["dn_to_reflectance", "ndvi", "green_cover_flag", "veg_density_class", "land_cover_class", "landuse_group", "is_motor_road", "is_major_road"]


def dn_to_reflectance(dn, scale: float = K.REFLECTANCE_SCALE, offset: float = 0.0) -> Column:
    d = _c(dn)
    return F.when(d != 0, d * F.lit(scale) + F.lit(offset))


def ndvi(nir, red) -> Column:
    n, r = _c(nir), _c(red)
    return clip(F.when(n + r > 0, (n - r) / (n + r)), -1.0, 1.0)


def green_cover_flag(value, threshold: float = K.GREEN_COVER_NDVI) -> Column:
    """1 above the threshold; a missing pixel counts as not green."""
    return F.coalesce(_c(value) > F.lit(threshold), F.lit(False)).cast("int")


def veg_density_class(value) -> Column:
    return classify_breaks(value, K.VEG_DENSITY_BREAKS)


def land_cover_class(value) -> Column:
    """1 water, 2 vegetation, 3 built-up, 4 bare land, 0 missing."""
    v = _c(value)
    return (
        F.when(v.isNull(), F.lit(0))
        .when(v < K.LANDCOVER_WATER_NDVI, F.lit(1))
        .when(v < K.LANDCOVER_BUILTUP_NDVI, F.lit(3))
        .when(v < K.LANDCOVER_BARE_NDVI, F.lit(4))
        .otherwise(F.lit(2))
    )


def landuse_group(value) -> Column:
    v = F.trim(_c(value))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for group, names in K.LANDUSE_GROUPS.items():
        out = out.when(v.isin(names), F.lit(group))
    return out.otherwise(F.lit("Other"))


def is_motor_road(highway) -> Column:
    return F.trim(_c(highway)).isin(K.MOTOR_ROADS)


def is_major_road(highway) -> Column:
    return F.trim(_c(highway)).isin(K.MAJOR_ROADS)
