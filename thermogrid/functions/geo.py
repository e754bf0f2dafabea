"""Geodesy and planar geometry on coordinate arrays (array<struct<x,y>>, x = longitude or easting)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from thermogrid import constants as K
from thermogrid.functions.numeric import _c

__all__ = [
    "haversine_m", "planar_distance", "segment_distance", "ring_area", "polygon_area_m2", "polyline_length_m",
    "vertex_centroid", "area_centroid", "flatten_positions", "point_in_ring", "metres_per_degree", "utm_epsg",
    "mercator_tile_x", "mercator_tile_y", "degree_tile_key", "degree_tile_name", "utm_forward", "utm_inverse",
    "RING_TYPE", "clip_to_box", "ring_turn", "clipped_length", "edge_cost",
]


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    a_lat, a_lng, b_lat, b_lng = (_c(v) for v in (lat1, lng1, lat2, lng2))
    half_lat = F.sin(F.radians(b_lat - a_lat) / F.lit(2.0))
    half_lng = F.sin(F.radians(b_lng - a_lng) / F.lit(2.0))
    a = half_lat * half_lat + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * half_lng * half_lng
    return F.lit(2.0 * K.EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar_distance(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a segment; a segment of no length is a point."""
    px, py, x1, y1, x2, y2 = (_c(v) for v in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / length2).otherwise(F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return planar_distance(px, py, x1 + t * dx, y1 + t * dy)


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(coords: Column) -> Column:
    """Consecutive position pairs of an open chain."""
    heads = F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 1, F.lit(0)))
    tails = F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0)))
    return F.arrays_zip(heads.alias("a"), tails.alias("b"))


def _sum_pairs(coords: Column, term) -> Column:
    return _let(coords, lambda c: F.aggregate(_pairs(c), F.lit(0.0), lambda acc, p: acc + term(p["a"], p["b"])))


def ring_area(coords) -> Column:
    """Area of a ring in squared units, closed or not."""
    c = _c(coords)
    closed = F.concat(c, F.slice(c, 1, 1))
    twice = _sum_pairs(closed, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(c) >= 3, F.abs(twice) / F.lit(2.0)).otherwise(F.lit(0.0))


def ring_turn(coords) -> Column:
    """1 for a ring that runs counter-clockwise, -1 clockwise, 0 without area."""
    c = _c(coords)

    def twice(ring: Column) -> Column:
        first = F.get(ring, 0)
        return _sum_pairs(ring, lambda a, b: (a["x"] - first["x"]) * (b["y"] - first["y"]) - (b["x"] - first["x"]) * (a["y"] - first["y"]))

    return F.signum(_let(c, twice))


def polygon_area_m2(coords) -> Column:
    """Area of a closed lon/lat ring: planar degrees scaled to metres at the reference latitude."""
    c = _c(coords)
    twice = _sum_pairs(c, lambda a, b: (b["x"] - a["x"]) * (b["y"] + a["y"]))
    area = F.abs(twice) / F.lit(2.0) * F.lit(K.M_PER_DEG_LNG) * F.lit(K.M_PER_DEG_LAT)
    return F.when(F.size(c) >= 4, area).otherwise(F.lit(0.0))


def polyline_length_m(coords) -> Column:
    """Haversine length of an open line; the line is not closed back to its start."""
    return _sum_pairs(_c(coords), lambda a, b: haversine_m(a["y"], a["x"], b["y"], b["x"]))


def vertex_centroid(coords) -> Column:
    """Mean of the vertices as struct<x,y>; null for an empty geometry."""
    c = _c(coords)
    n = F.size(c)
    sx = F.aggregate(c, F.lit(0.0), lambda acc, p: acc + p["x"])
    sy = F.aggregate(c, F.lit(0.0), lambda acc, p: acc + p["y"])
    return F.when(n > 0, F.struct((sx / n).alias("x"), (sy / n).alias("y")))


def area_centroid(coords) -> Column:
    """Area-weighted centroid of a ring as struct<x,y>."""
    c = _c(coords)
    closed = F.concat(c, F.slice(c, 1, 1))

    def cross(a, b):
        return a["x"] * b["y"] - b["x"] * a["y"]

    twice = _sum_pairs(closed, cross)
    cx = _sum_pairs(closed, lambda a, b: (a["x"] + b["x"]) * cross(a, b))
    cy = _sum_pairs(closed, lambda a, b: (a["y"] + b["y"]) * cross(a, b))
    return F.when(
        F.abs(twice) > 0,
        F.struct((cx / (F.lit(3.0) * twice)).alias("x"), (cy / (F.lit(3.0) * twice)).alias("y")),
    ).otherwise(vertex_centroid(c))


def flatten_positions(geom_type, coordinates_json) -> Column:
    """GeoJSON coordinates text of any geometry type to one flat list of positions."""
    kind, text = _c(geom_type), _c(coordinates_json)

    def positions(rows: Column) -> Column:
        return F.transform(rows, lambda p: F.struct(p.getItem(0).alias("x"), p.getItem(1).alias("y")))

    one = F.array(F.from_json(text, "array<double>"))
    two = F.from_json(text, "array<array<double>>")
    three = F.flatten(F.from_json(text, "array<array<array<double>>>"))
    four = F.flatten(F.flatten(F.from_json(text, "array<array<array<array<double>>>>")))
    return (
        F.when(kind == "Point", positions(one))
        .when(kind.isin("LineString", "MultiPoint"), positions(two))
        .when(kind.isin("Polygon", "MultiLineString"), positions(three))
        .when(kind == "MultiPolygon", positions(four))
    )


def point_in_ring(px, py, coords) -> Column:
    """Ray casting: an odd number of crossings lies inside."""
    px, py, c = _c(px), _c(py), _c(coords)
    closed = F.concat(c, F.slice(c, 1, 1))

    def crossing(a, b):
        spans = (a["y"] > py) != (b["y"] > py)
        at = (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]
        return F.when(spans & (px < at), F.lit(1)).otherwise(F.lit(0))

    crossings = _let(closed, lambda ring: F.aggregate(_pairs(ring), F.lit(0), lambda acc, p: acc + crossing(p["a"], p["b"])))
    return crossings % 2 == 1


def metres_per_degree(lat) -> tuple[Column, Column]:
    """(metres per degree of longitude, of latitude)."""
    la = _c(lat)
    per_x = F.lit(111320.0) * F.cos(F.radians(la))
    per_y = F.lit(111132.0) - F.lit(559.0) * F.cos(F.lit(2.0) * F.radians(la))
    return per_x, per_y


def utm_epsg(lon, lat) -> Column:
    zone = F.floor((_c(lon) + F.lit(180.0)) / F.lit(6.0)).cast("int") + F.lit(1)
    return F.when(_c(lat) >= 0, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)


def mercator_tile_x(lng, zoom: int) -> Column:
    return (_c(lng) + F.lit(180.0)) / F.lit(360.0) * F.lit(float(2**zoom))


def mercator_tile_y(lat, zoom: int) -> Column:
    mercator = F.asinh(F.tan(F.radians(_c(lat)))) / F.lit(math.pi)
    return (F.lit(1.0) - mercator) / F.lit(2.0) * F.lit(float(2**zoom))


def degree_tile_key(lon, lat) -> Column:
    """South-west corner of the 1-degree tile as struct<lat0,lon0>."""
    return F.struct(F.floor(_c(lat)).cast("int").alias("lat0"), F.floor(_c(lon)).cast("int").alias("lon0"))


def degree_tile_name(lat0, lon0) -> Column:
    la, lo = _c(lat0), _c(lon0)
    ns = F.when(la >= 0, F.lit("N")).otherwise(F.lit("S"))
    ew = F.when(lo >= 0, F.lit("E")).otherwise(F.lit("W"))
    return F.concat(
        F.lit("Copernicus_DSM_COG_10_"), ns, F.lpad(F.abs(la).cast("string"), 2, "0"), F.lit("_00_"),
        ew, F.lpad(F.abs(lo).cast("string"), 3, "0"), F.lit("_00_DEM"),
    )


# Transverse Mercator by the Krueger series on the WGS84 ellipsoid (published constants).
_A = 6378137.0
_FLAT = 1.0 / 298.257223563
_N = _FLAT / (2.0 - _FLAT)
_RECT = _A / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_ECC = 2.0 * math.sqrt(_N) / (1.0 + _N)
_K0, _FALSE_E = 0.9996, 500000.0


def utm_forward(lon, lat, zone: int = K.UTM_ZONE_45N) -> Column:
    """Longitude and latitude to UTM metres (northern half), struct<x,y>."""
    central = math.radians(zone * 6 - 183)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon)) - F.lit(central)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, start=1):
        north = north + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        east = east + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    scale = F.lit(_K0 * _RECT)
    return F.struct((F.lit(_FALSE_E) + scale * east).alias("x"), (scale * north).alias("y"))


def utm_inverse(x, y, zone: int = K.UTM_ZONE_45N) -> Column:
    """UTM metres (northern half) to longitude and latitude, struct<x,y>."""
    xi, eta = _c(y) / F.lit(_K0 * _RECT), (_c(x) - F.lit(_FALSE_E)) / F.lit(_K0 * _RECT)
    north, east = xi, eta
    for j, b in enumerate(_BETA, start=1):
        north = north - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        east = east - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    tau_c = F.sin(north) / F.sqrt(F.sinh(east) * F.sinh(east) + F.cos(north) * F.cos(north))
    chi = F.atan(tau_c)
    # Conformal to geodetic latitude (series in n).
    deltas = [
        2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
        7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
        56 * _N**3 / 15 - 136 * _N**4 / 35,
        4279 * _N**4 / 630,
    ]
    phi = chi
    for j, d in enumerate(deltas, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lam = F.lit(math.radians(zone * 6 - 183)) + F.atan2(F.sinh(east), F.cos(north))
    return F.struct(F.degrees(lam).alias("x"), F.degrees(phi).alias("y"))


RING_TYPE = "array<struct<x: double, y: double>>"


def clip_to_box(coords, left, bottom, right, top) -> Column:
    """A ring cut to a rectangle: one fold over the four sides (Sutherland-Hodgman)."""

    def side(vertical: bool, bound, above: bool) -> Column:
        return F.struct(F.lit(vertical).alias("vertical"), _c(bound).cast("double").alias("at"), F.lit(above).alias("above"))

    sides = F.array(side(True, left, True), side(True, right, False), side(False, bottom, True), side(False, top, False))

    def cut_by(ring: Column, s: Column) -> Column:
        def along(p):
            return F.when(s["vertical"], p["x"]).otherwise(p["y"])

        def inside(p):
            return F.when(s["above"], along(p) >= s["at"]).otherwise(along(p) <= s["at"])

        def meet(a, b):
            t = (s["at"] - along(a)) / F.when(along(b) != along(a), along(b) - along(a))
            x, y = a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])
            return F.struct(F.when(s["vertical"], s["at"]).otherwise(x).alias("x"), F.when(s["vertical"], y).otherwise(s["at"]).alias("y"))

        def step(e):
            a, b = e["a"], e["b"]
            return (
                F.when(inside(a) & inside(b), F.array(b))
                .when(inside(a), F.array(meet(a, b)))
                .when(inside(b), F.array(meet(a, b), b))
                .otherwise(F.array().cast(RING_TYPE))
            )

        return _let(F.concat(ring, F.slice(ring, 1, 1)), lambda closed: F.flatten(F.transform(_pairs(closed), step)).cast(RING_TYPE))

    return F.aggregate(sides, _c(coords).cast(RING_TYPE), cut_by)


def clipped_length(x1, y1, x2, y2, left, bottom, right, top) -> Column:
    """Length of a segment inside a rectangle (Liang-Barsky)."""
    x1, y1, x2, y2, left, bottom, right, top = (_c(v) for v in (x1, y1, x2, y2, left, bottom, right, top))
    dx, dy = x2 - x1, y2 - y1

    def interval(start, delta, low, high):
        t_low, t_high = (low - start) / F.when(delta != 0, delta), (high - start) / F.when(delta != 0, delta)
        within = (start >= low) & (start <= high)
        enter = F.when(delta != 0, F.least(t_low, t_high)).otherwise(F.when(within, F.lit(0.0)).otherwise(F.lit(2.0)))
        leave = F.when(delta != 0, F.greatest(t_low, t_high)).otherwise(F.when(within, F.lit(1.0)).otherwise(F.lit(-1.0)))
        return enter, leave

    ex, lx = interval(x1, dx, left, right)
    ey, ly = interval(y1, dy, bottom, top)
    share = F.least(F.lit(1.0), lx, ly) - F.greatest(F.lit(0.0), ex, ey)
    return F.greatest(F.lit(0.0), share) * F.sqrt(dx * dx + dy * dy)


def edge_cost(distance_m, lst, reference: Column, std: Column, weight: float) -> Column:
    """Walking distance made dearer by heat: distance * (1 + w * clip((lst - p60) / std, 0, 3))."""
    heat = (_c(lst) - reference) / F.greatest(std, F.lit(1e-6))
    clipped = F.when(heat < 0, F.lit(0.0)).when(heat > 3, F.lit(3.0)).otherwise(heat)
    return _c(distance_m) * (F.lit(1.0) + F.lit(weight) * clipped)
