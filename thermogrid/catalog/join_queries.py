"""Spatial, as-of and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid import constants as K, functions as fn
from thermogrid.catalog.function_queries import hav, lonlat_ring, RING_AREA_SQL
from thermogrid.catalog.registry import query
from thermogrid.functions import round_even
from thermogrid.operators import grid as G, raster as RS, series as SR, spatial as S
from thermogrid.plans import city as C, feature_table as FT, temporal as TP


def r6(*names):
    return [round_even(n, 6).alias(n) for n in names]


def point_features(df, key="point_id", carry=()):
    return df.select(F.col(key).alias("feature_id"), *carry, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))


def cell_queries(d):
    return d.cells.select(F.col("grid_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))


def boundary(d, cut: bool):
    """A one-row outline around all points: a box, or the box with its corners cut."""
    b = d.points.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("e"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, lo, c, hi = F.col("a"), F.col("b"), F.col("c"), F.col("e")
    box = [pt(a, lo), pt(c, lo), pt(c, hi), pt(a, hi)]
    w, h = (c - a) * 0.3, (hi - lo) * 0.2
    octagon = [pt(a + w, lo), pt(c - w, lo), pt(c, lo + h), pt(c, hi - h), pt(c - w, hi), pt(a + w, hi), pt(a, hi - h), pt(a, lo + h)]
    return b.select(F.array(*(octagon if cut else box)).alias("ring"))


@query("grid_generation_J1", """
    WITH b AS (SELECT min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS e FROM points),
    n AS (SELECT *, CAST(ceil((c - a) / 100.0e0) AS BIGINT) AS nx, CAST(ceil((e - b) / 100.0e0) AS BIGINT) AS ny FROM b)
    SELECT CAST(i.ix * ny + j.iy + 1 AS BIGINT) AS grid_id, R4(least(100.0e0, c - a - i.ix * 100) * least(100.0e0, e - b - j.iy * 100)) AS area_m2,
      R4(a + i.ix * 100 + least(100.0e0, c - a - i.ix * 100) / 2) AS cx, R4(b + j.iy * 100 + least(100.0e0, e - b - j.iy * 100) / 2) AS cy
    FROM n, LATERAL (SELECT unnest(generate_series(0, nx - 1)) AS ix) i, LATERAL (SELECT unnest(generate_series(0, ny - 1)) AS iy) j""")
def _(d):
    g = G.generate_grid(boundary(d, cut=False))
    return g.select("grid_id", *[round_even(c, 4).alias(c) for c in ("area_m2", "cx", "cy")])


@query("polygon_cell_clip_X2", """
    WITH b AS (SELECT min(x) AS a, min(y) AS lo, max(x) AS c, max(y) AS hi FROM points),
    q AS (SELECT *, (c - a) * 0.3e0 AS w, (hi - lo) * 0.2e0 AS h FROM b),
    p AS (SELECT 0 AS i, w AS x, 0.0e0 AS y FROM q UNION ALL SELECT 1, c - a - w, 0.0e0 FROM q UNION ALL SELECT 2, c - a, h FROM q UNION ALL SELECT 3, c - a, hi - lo - h FROM q UNION ALL
      SELECT 4, c - a - w, hi - lo FROM q UNION ALL SELECT 5, w, hi - lo FROM q UNION ALL SELECT 6, 0.0e0, hi - lo - h FROM q UNION ALL SELECT 7, 0.0e0, h FROM q),
    e AS (SELECT s.x AS x1, s.y AS y1, t.x AS x2, t.y AS y2 FROM p s JOIN p t ON t.i = (s.i + 1) % 8 WHERE s.y <> t.y),
    r AS (SELECT iy, x1, y1, x2, y2, greatest(iy * 100.0e0, least(iy * 100.0e0 + 100, y1)) AS ya, greatest(iy * 100.0e0, least(iy * 100.0e0 + 100, y2)) AS yb
      FROM e, LATERAL (SELECT unnest(generate_series(CAST(floor(least(y1, y2) / 100) AS BIGINT), CAST(floor(greatest(y1, y2) / 100) AS BIGINT))) AS iy) k),
    f AS (SELECT iy, ya - iy * 100 AS ya, yb - iy * 100 AS yb, x1 + (ya - y1) / (y2 - y1) * (x2 - x1) AS xa, x1 + (yb - y1) / (y2 - y1) * (x2 - x1) AS xb FROM r),
    g AS (SELECT iy, ix, ya, yb, xa - ix * 100 AS xa, xb - ix * 100 AS xb, greatest(0.0e0, least(100.0e0, xa - ix * 100)) AS p, greatest(0.0e0, least(100.0e0, xb - ix * 100)) AS q
      FROM f, LATERAL (SELECT unnest(generate_series(0, (SELECT CAST(floor((c - a) / 100) AS BIGINT) FROM b))) AS ix) k),
    -- The stretch within the cell, and the heights of what lies left of it.
    m AS (SELECT *, CASE WHEN xa = xb THEN ya ELSE ya + (p - xa) / (xb - xa) * (yb - ya) END AS u, CASE WHEN xa = xb THEN yb ELSE ya + (q - xa) / (xb - xa) * (yb - ya) END AS v,
        greatest(xa, xb) < 0 AS l, least(xa, xb) > 100 AS o FROM g),
    n AS (SELECT iy, ix,
        CASE WHEN o THEN 0 WHEN l THEN (yb - ya) * 100 ELSE (v - u) * (100 - (p + q) / 2) + (CASE WHEN xa < 0 THEN u - ya ELSE 0 END + CASE WHEN xb < 0 THEN yb - v ELSE 0 END) * 100 END AS area,
        CASE WHEN o THEN 0 WHEN l THEN (yb - ya) * 5000 ELSE (v - u) * (10000 - (p * p + p * q + q * q) / 3) / 2 + (CASE WHEN xa < 0 THEN u - ya ELSE 0 END + CASE WHEN xb < 0 THEN yb - v ELSE 0 END) * 5000 END AS mx,
        CASE WHEN o THEN 0 WHEN l THEN (yb * yb - ya * ya) * 50 ELSE (v - u) * (50 * (u + v) - (2 * p * u + p * v + q * u + 2 * q * v) / 6)
          + (CASE WHEN xa < 0 THEN u * u - ya * ya ELSE 0 END + CASE WHEN xb < 0 THEN yb * yb - v * v ELSE 0 END) * 50 END AS my FROM m),
    t AS (SELECT ix, iy, -sum(area) AS area, -sum(mx) AS mx, -sum(my) AS my FROM n GROUP BY ix, iy)
    SELECT CAST(ix * ceil((hi - lo) / 100.0e0) + iy + 1 AS BIGINT) AS grid_id, ix, iy, R4(area) AS area_m2, R4(mx / area + ix * 100 + a) AS cx, R4(my / area + iy * 100 + lo) AS cy
    FROM t, b WHERE area > 1e-6""")
def _(d):
    g = G.generate_grid(boundary(d, cut=True))
    return g.select("grid_id", "ix", "iy", *[round_even(c, 4).alias(c) for c in ("area_m2", "cx", "cy")])


_TOUCH = "LATERAL (SELECT unnest(generate_series(CAST(ceil({a} / 100.0e0) AS BIGINT) - 1, CAST(floor({b} / 100.0e0) AS BIGINT))) AS {n}) {q}"


def touch(x0, y0, x1, y1):
    return _TOUCH.format(a=x0, b=x1, n="ix", q="tx") + ", " + _TOUCH.format(a=y0, b=y1, n="iy", q="ty")


POINT_COUNT_SQL = f"SELECT tx.ix, ty.iy, count(*) AS n FROM points, {touch('x', 'y', 'x', 'y')} GROUP BY tx.ix, ty.iy"


@query("points_per_cell_J2", f"""
    WITH n AS ({POINT_COUNT_SQL}) SELECT c.grid_id, coalesce(n.n, 0) AS n FROM cells c LEFT JOIN n ON n.ix = c.ix AND n.iy = c.iy""")
def _(d):
    counts = S.count_per_cell(d.points, "x", "y")
    return d.cells.select("grid_id", "ix", "iy").join(counts, ["ix", "iy"], "left").select("grid_id", F.coalesce("n", F.lit(0)).alias("n"))


_OVER = "greatest(0.0e0, least(x1, tx.ix * 100.0e0 + 100) - greatest(x0, tx.ix * 100.0e0)) * greatest(0.0e0, least(y1, ty.iy * 100.0e0 + 100) - greatest(y0, ty.iy * 100.0e0))"


@query("overlay_area_J3", f"SELECT tx.ix, ty.iy, R4(sum({_OVER})) AS area FROM rects, {touch('x0', 'y0', 'x1', 'y1')} GROUP BY tx.ix, ty.iy HAVING sum({_OVER}) > 0")
def _(d):
    pt = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    rings = d.rects.select(F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1")).alias("ring"))
    return G.polygon_overlap_per_cell(rings).select("ix", "iy", round_even("area", 4).alias("area"))


LINE_SQL = """
    WITH s AS (SELECT highway, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, least(x1, x2) AS a, greatest(x1, x2) AS b, least(y1, y2) AS c, greatest(y1, y2) AS e FROM segments),
    g AS (SELECT * FROM s, LATERAL (SELECT unnest(generate_series(CAST(floor(a / 100) AS BIGINT), CAST(floor(b / 100) AS BIGINT))) AS ix) i,
      LATERAL (SELECT unnest(generate_series(CAST(floor(c / 100) AS BIGINT), CAST(floor(e / 100) AS BIGINT))) AS iy) j),
    t AS (SELECT highway, ix, iy, sqrt(dx * dx + dy * dy) AS len,
      greatest(0.0e0, CASE WHEN dx <> 0 THEN least((ix * 100.0e0 - x1) / dx, (ix * 100.0e0 + 100 - x1) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((iy * 100.0e0 - y1) / dy, (iy * 100.0e0 + 100 - y1) / dy) ELSE 0 END) AS lo,
      least(1.0e0, CASE WHEN dx <> 0 THEN greatest((ix * 100.0e0 - x1) / dx, (ix * 100.0e0 + 100 - x1) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((iy * 100.0e0 - y1) / dy, (iy * 100.0e0 + 100 - y1) / dy) ELSE 1 END) AS hi FROM g),
    lengths AS (SELECT highway, ix, iy, (hi - lo) * len AS length FROM t WHERE hi > lo)
"""


@query("overlay_length_J4", LINE_SQL + "SELECT ix, iy, R4(sum(length)) AS length FROM lengths GROUP BY ix, iy HAVING sum(length) > 0")
def _(d):
    return S.line_length_per_cell(d.segments).where("length > 0").select("ix", "iy", round_even("length", 4).alias("length"))


@query("nearest_feature_J5", """
    SELECT c.grid_id, R4(sqrt(min((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)))) AS distance FROM cells c, points p GROUP BY c.grid_id""")
def _(d):
    near = S.nearest_features(cell_queries(d), point_features(d.points))
    return near.select(F.col("query_id").alias("grid_id"), round_even("distance", 4).alias("distance"))


@query("nearest_major_road_J5b", """
    WITH m AS (SELECT x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM segments WHERE trim(highway) IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'tertiary_link')),
    t AS (SELECT c.grid_id, c.x, c.y, m.*, least(1.0e0, greatest(0.0e0, CASE WHEN dx * dx + dy * dy > 0 THEN ((c.x - x1) * dx + (c.y - y1) * dy) / (dx * dx + dy * dy) ELSE 0 END)) AS u FROM cells c, m)
    SELECT grid_id, R4(sqrt(min((x - x1 - u * dx) * (x - x1 - u * dx) + (y - y1 - u * dy) * (y - y1 - u * dy)))) AS distance FROM t GROUP BY grid_id""")
def _(d):
    major = d.segments.where(fn.is_major_road("highway")).select(F.col("segment_id").alias("feature_id"), "x1", "y1", "x2", "y2")
    near = S.nearest_features(cell_queries(d), major)
    return near.select(F.col("query_id").alias("grid_id"), round_even("distance", 4).alias("distance"))


_GROUPS = ["Residential", "Commercial", "Industrial", "Institutional", "Agriculture", "Green", "Railway", "Other"]
_CLASS = """CASE trim(landuse) WHEN 'residential' THEN 'Residential' WHEN 'retail' THEN 'Commercial' WHEN 'quarry' THEN 'Industrial' WHEN 'religious' THEN 'Institutional'
      WHEN 'orchard' THEN 'Agriculture' WHEN 'forest' THEN 'Green' WHEN 'grass' THEN 'Green' WHEN 'railway' THEN 'Railway' ELSE 'Other' END"""


@query("landuse_shares_J6", f"""
    WITH a AS (SELECT tx.ix, ty.iy, {_CLASS} AS cls, sum({_OVER}) AS area FROM rects, {touch('x0', 'y0', 'x1', 'y1')} GROUP BY tx.ix, ty.iy, 3)
    SELECT c.grid_id, {", ".join(f"R4(coalesce(sum(CASE WHEN cls = '{g}' THEN area END), 0.0e0) / 10000.0e0 * 100) AS landuse_{g.lower()}_pct" for g in _GROUPS)}
    FROM cells c LEFT JOIN a ON a.ix = c.ix AND a.iy = c.iy GROUP BY c.grid_id""")
def _(d):
    classed = d.rects.withColumn("cls", fn.landuse_group("landuse"))
    per = S.rect_overlap_per_cell(classed, by=["cls"])
    wide = per.groupBy("ix", "iy").pivot("cls", _GROUPS).agg(F.sum("area"))
    joined = d.cells.select("grid_id", "ix", "iy").join(wide, ["ix", "iy"], "left")
    area = K.CELL_SIZE_M**2
    return joined.select("grid_id", *[round_even(F.coalesce(F.col(g), F.lit(0.0)) / F.lit(area) * 100, 4).alias(f"landuse_{g.lower()}_pct") for g in _GROUPS])


@query("amenity_block_J7", f"""
    WITH p AS (SELECT * FROM points WHERE kind = 'BUILDING'),
    n AS ({POINT_COUNT_SQL.replace('FROM points', 'FROM p')}),
    near AS (SELECT c.grid_id, sqrt(min((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y))) AS d FROM cells c, p GROUP BY c.grid_id)
    SELECT c.grid_id, coalesce(n.n, 0) AS n, R4(coalesce(n.n, 0) / 0.01e0) AS density, R4(near.d) AS distance
    FROM cells c LEFT JOIN n ON n.ix = c.ix AND n.iy = c.iy LEFT JOIN near ON near.grid_id = c.grid_id""")
def _(d):
    amenity = d.points.where("kind = 'BUILDING'")
    counts = S.count_per_cell(amenity, "x", "y")
    near = S.nearest_features(cell_queries(d), point_features(amenity)).select(F.col("query_id").alias("grid_id"), "distance")
    n = F.coalesce(F.col("n"), F.lit(0))
    joined = d.cells.select("grid_id", "ix", "iy").join(counts, ["ix", "iy"], "left").join(near, "grid_id", "left")
    return joined.select("grid_id", n.alias("n"), round_even(n / 0.01, 4).alias("density"), round_even("distance", 4).alias("distance"))


# A drawn, non-convex outline in lon/lat.
OUTLINE = [(85.7111, 20.1077), (85.7713, 20.1133), (85.7477, 20.1519), (85.7891, 20.1987), (85.7303, 20.1803), (85.7201, 20.1451)]


def pip_sql(x: str, y: str) -> str:
    edges = list(zip(OUTLINE, [*OUTLINE[1:], OUTLINE[0]]))
    terms = [
        f"(CASE WHEN ({a[1]}e0 > {y}) <> ({b[1]}e0 > {y}) AND {x} < ({b[0]}e0 - {a[0]}e0) * ({y} - {a[1]}e0) / ({b[1]}e0 - {a[1]}e0) + {a[0]}e0 THEN 1 ELSE 0 END)" for a, b in edges
    ]
    return f"(({' + '.join(terms)}) % 2 = 1)"


@query("point_in_polygon_J8", f"SELECT grid_id FROM cells WHERE {pip_sql('lon', 'lat')}")
def _(d):
    return S.cells_with_fallback(d.cells, "lon", "lat", OUTLINE).select("grid_id")


AREA_SQL = """
    WITH t AS (SELECT n_name AS name, 85.7031e0 + (n_nationkey % 5) * 0.0213e0 AS ax, 20.1017e0 + floor(n_nationkey / 5.0e0) * 0.0197e0 AS ay FROM nation),
    area AS (SELECT name, ax, ay, ax + 0.0507e0 AS bx, ay + 0.0071e0 AS by_, ax + 0.0203e0 AS cx, ay + 0.0411e0 AS cy FROM t)
"""


def triangles(d):
    k = F.col("n_nationkey")
    ax, ay = F.lit(85.7031) + (k % 5) * F.lit(0.0213), F.lit(20.1017) + F.floor(k / 5.0) * F.lit(0.0197)
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return d.nation.select(F.col("n_name").alias("name"), F.array(pt(ax, ay), pt(ax + F.lit(0.0507), ay + F.lit(0.0071)), pt(ax + F.lit(0.0203), ay + F.lit(0.0411))).alias("coords"))


@query("named_area_J9", AREA_SQL + """
    SELECT c.grid_id FROM cells c JOIN area ON lower(name) = 'nation_7'
      AND (bx - ax) * (lat - ay) - (by_ - ay) * (lon - ax) > 0 AND (cx - bx) * (lat - by_) - (cy - by_) * (lon - bx) > 0 AND (ax - cx) * (lat - cy) - (ay - cy) * (lon - cx) > 0""")
def _(d):
    return S.select_in_named_area(d.cells, triangles(d), "Nation_7", "lon", "lat", 0.01).select("grid_id")


@query("radius_selection_J10", f"""
    SELECT grid_id, sqrt((lon - 85.7507e0) * (lon - 85.7507e0) + (lat - 20.1511e0) * (lat - 20.1511e0)) <= 1500 / 111000.0e0 AS planar,
      {hav('20.1511e0', '85.7507e0', 'lat', 'lon')} <= 1500 AS sphere FROM cells
    WHERE sqrt((lon - 85.7507e0) * (lon - 85.7507e0) + (lat - 20.1511e0) * (lat - 20.1511e0)) <= 1500 / 111000.0e0 OR {hav('20.1511e0', '85.7507e0', 'lat', 'lon')} <= 1500""")
def _(d):
    center = (85.7507, 20.1511)
    a = S.select_in_radius(d.cells, "lon", "lat", center, 1500).select("grid_id", F.lit(True).alias("planar"))
    b = S.select_in_radius(d.cells, "lon", "lat", center, 1500, exact=True).select("grid_id", F.lit(True).alias("sphere"))
    return a.join(b, "grid_id", "outer").na.fill(False, ["planar", "sphere"])


@query("id_selection_J11", "SELECT grid_id, R6(mean_lst) AS mean_lst FROM cells WHERE grid_id IN (SELECT o_custkey FROM orders)")
def _(d):
    return S.select_by_ids(d.cells, d.orders.select(F.col("o_custkey").alias("grid_id"))).select("grid_id", *r6("mean_lst"))


@query("outer_feature_join_J12", f"""
    WITH v AS ({POINT_COUNT_SQL}), r AS (SELECT ix, iy, avg(lst_c) AS mean FROM lst_pixels WHERE lst_c IS NOT NULL GROUP BY ix, iy)
    SELECT coalesce(v.ix, r.ix) AS ix, coalesce(v.iy, r.iy) AS iy, v.n, R6(r.mean) AS mean FROM v FULL OUTER JOIN r ON v.ix = r.ix AND v.iy = r.iy""")
def _(d):
    vector = S.count_per_cell(d.points, "x", "y")
    raster = RS.zonal_statistics(d.lst_pixels, ["ix", "iy"], "lst_c").select("ix", "iy", "mean")
    return vector.join(raster, ["ix", "iy"], "outer").select("ix", "iy", "n", *r6("mean"))


@query("left_feature_join_J13", f"WITH v AS ({POINT_COUNT_SQL}) SELECT grid_id, v.n, R6(mean_lst) AS mean_lst FROM cells c LEFT JOIN v ON v.ix = c.ix AND v.iy = c.iy")
def _(d):
    return d.cells.join(S.count_per_cell(d.points, "x", "y"), ["ix", "iy"], "left").select("grid_id", "n", *r6("mean_lst"))


@query("weather_row_on_cells_J14", """
    WITH w AS (SELECT R4(avg(t2m)) AS t2m, R4(max(rh2m)) AS rh2m FROM weather_daily) SELECT grid_id, t2m, rh2m FROM cells, w""")
def _(d):
    row = d.weather_daily.agg(round_even(F.avg("t2m"), 4).alias("t2m"), round_even(F.max("rh2m"), 4).alias("rh2m"))
    return FT.assemble(d.cells.select("grid_id"), [], row)


@query("nearest_date_join_J15", """
    WITH e AS (SELECT DISTINCT event_type AS site, CAST(ts AS DATE) AS date FROM events
      UNION SELECT DISTINCT s.site, CAST(DATE '2024-01-01' + CAST(n_nationkey * 5 AS INT) - 10 AS DATE) FROM nation, (SELECT DISTINCT event_type AS site FROM events) s),
    r AS (SELECT e.site, e.date, w.date AS nearest_date, w.t2m, row_number() OVER (PARTITION BY e.site, e.date ORDER BY abs(date_diff('day', e.date, w.date)), w.date) AS rn
      FROM e JOIN weather_daily w ON w.site = e.site)
    SELECT site, date, nearest_date, R6(t2m) AS t2m FROM r WHERE rn = 1""")
def _(d):
    series = d.weather_daily.select("site", "date", "t2m")
    a = d.events.select(F.col("event_type").alias("site"), F.to_date("ts").alias("date"))
    b = d.nation.select(F.expr("date_add(date'2024-01-01', n_nationkey * 5 - 10)").alias("date"))
    # Every station is asked for the dates of a short fixed list, beside its own.
    events = a.union(a.select("site").distinct().crossJoin(b).select("site", "date")).distinct()
    return SR.nearest_date_join(events, series, "date", "date", by=["site"]).select("site", "date", "nearest_date", round_even("nearest_t2m", 6).alias("t2m"))


@query("monthly_lookup_J16", """
    WITH m AS (SELECT date_trunc('month', date) AS month, avg(t2m) AS t2m, avg(ws2m) AS ws2m FROM weather_long GROUP BY 1)
    SELECT o.o_orderkey, R6(m.t2m) AS t2m_monthly_mean, R6(m.ws2m) AS ws2m_monthly_mean FROM orders o LEFT JOIN m ON m.month = date_trunc('month', o.o_orderdate)""")
def _(d):
    monthly = SR.monthly_means(d.weather_long.withColumn("site", F.lit("city")), ["site"], "date", ["t2m", "ws2m"])
    events = d.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return SR.month_lookup_join(events, monthly, "date", ["t2m", "ws2m"]).select("o_orderkey", *r6("t2m_monthly_mean", "ws2m_monthly_mean"))


@query("zonal_pixel_join_J17", "SELECT row_id, col_id, x, CAST(floor(x / 100.0e0) AS BIGINT) AS ix, CAST(floor(y / 100.0e0) AS BIGINT) AS iy FROM pixels")
def _(d):
    return RS.pixels_to_cells(d.pixels.drop("ix", "iy"), "x", "y").select("row_id", "col_id", "x", "ix", "iy")


@query("resample_nearest_J18", """
    SELECT "row" * 3 + r.r AS "row", col * 3 + c.c AS col, R6(ground) AS value FROM dem, (VALUES (0), (1), (2)) AS r(r), (VALUES (0), (1), (2)) AS c(c)""")
def _(d):
    return RS.resample_nearest(d.dem.select("row", "col", F.col("ground").alias("value")), 3).select("row", "col", *r6("value"))


@query("raster_sampling_J19", """
    SELECT p.point_id, R6(m.elevation) AS elevation FROM points p LEFT JOIN dem m ON m.col = floor((p.x - 50) / 100.0e0) AND m."row" = floor((11000 - p.y) / 100.0e0)
      AND floor((p.x - 50) / 100.0e0) BETWEEN 0 AND 119 AND floor((11000 - p.y) / 100.0e0) BETWEEN 0 AND 99""")
def _(d):
    out = RS.sample_at_points(d.points, d.dem, "x", "y", (50.0, 11000.0), (100.0, -100.0), (100, 120), "elevation")
    return out.select("point_id", *r6("elevation"))


TEMPORAL_SQL = """
    WITH f AS (SELECT scene_id, count(lst_c) * 1.0e0 / count(*) AS f FROM cell_lst_dates GROUP BY scene_id)
    SELECT o.scene_id, o.grid_id, R6(o.lst_c) AS lst_c, {cols} FROM cell_lst_dates o JOIN f ON f.scene_id = o.scene_id AND f.f >= 0.3e0
    LEFT JOIN cells c ON c.grid_id = o.grid_id LEFT JOIN weather_daily w ON w.date = o.date
      AND w.site = CASE o.scene_key % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END"""


def temporal(d):
    static = d.cells.select("grid_id", "green_cover", "mean_ndvi", "x", "y")
    stations = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))  # each scene lies near one station
    scenes = d.cell_lst_dates.withColumn("site", F.element_at(stations, (F.col("scene_key") % 5 + 1).cast("int")))
    return TP.build_dataset(scenes, static, d.weather_daily.select("site", "date", "t2m", "rh2m"), by=["site"])


@query("scene_static_join_J20", TEMPORAL_SQL.format(cols="R6(c.green_cover) AS green_cover, R6(c.mean_ndvi) AS mean_ndvi"))
def _(d):
    return temporal(d).select("scene_id", "grid_id", *r6("lst_c", "green_cover", "mean_ndvi"))


@query("weather_by_date_J21", TEMPORAL_SQL.format(cols="R6(w.t2m) AS t2m, R6(w.rh2m) AS rh2m"))
def _(d):
    return temporal(d).select("scene_id", "grid_id", *r6("lst_c", "t2m", "rh2m"))


@query("inverse_distance_J22", """
    WITH r AS (SELECT c.grid_id, s.pm10 AS z, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2,
        row_number() OVER (PARTITION BY c.grid_id ORDER BY sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)), s.station_id) AS rn FROM cells c, stations s)
    SELECT grid_id, R6(coalesce(min(CASE WHEN d2 = 0 THEN z END), sum(z / d2) / sum(1 / d2))) AS pm10 FROM r WHERE rn <= 4 GROUP BY grid_id""")
def _(d):
    near = S.nearest_features(cell_queries(d), point_features(d.stations, "station_id", ["pm10"]), k=4, carry=["pm10"])
    return S.inverse_distance(near, "query_id", "pm10").select(F.col("query_id").alias("grid_id"), *r6("pm10"))


NEAREST_CELL_SQL = f"""
    WITH r AS (SELECT s.point_id, c.grid_id, {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} AS m FROM points s, cells c),
    near AS (SELECT point_id, grid_id, m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY m, grid_id) AS rn FROM r) q WHERE rn = 1 AND m <= 3000)
"""


@query("nearest_cell_J23", NEAREST_CELL_SQL + "SELECT point_id, R2(m) AS distance_m FROM near")
def _(d):
    return C.nearest_cells(d.points.select("point_id", "lon", "lat"), d.cells).select("point_id", round_even("distance_m", 2).alias("distance_m"))


@query("baseline_fallback_J24", """
    SELECT c.grid_id, R6(coalesce(a.b, p.predicted_lst)) AS predicted_lst FROM cells c LEFT JOIN (SELECT DISTINCT o_custkey AS g, o_custkey % 50 * 1.0e0 AS b FROM orders) a ON a.g = c.grid_id
      LEFT JOIN (SELECT * FROM predictions WHERE fold = 0) p ON p.grid_id = c.grid_id""")
def _(d):
    scenario = d.orders.select(F.col("o_custkey").alias("grid_id"), (F.col("o_custkey") % 50).cast("double").alias("baseline_lst")).distinct()
    return C.baseline_with_fallback(d.cells.select("grid_id"), scenario, d.predictions.where("fold = 0")).select("grid_id", *r6("predicted_lst"))


@query("point_profile_J25", NEAREST_CELL_SQL + """
    SELECT p.point_id, near.grid_id IS NOT NULL AS available, R6(c.mean_lst) AS mean_lst, R6(q.predicted_lst) AS predicted_lst,
      CASE WHEN c.mean_aqi IS NULL THEN NULL WHEN c.mean_aqi <= 50 THEN 'Good' WHEN c.mean_aqi <= 100 THEN 'Satisfactory' WHEN c.mean_aqi <= 200 THEN 'Moderate'
        WHEN c.mean_aqi <= 300 THEN 'Poor' WHEN c.mean_aqi <= 400 THEN 'Very Poor' ELSE 'Severe' END AS aqi_class,
      CASE WHEN c.building_coverage_pct IS NULL THEN NULL WHEN c.building_coverage_pct >= 60 THEN 'High' WHEN c.building_coverage_pct >= 30 THEN 'Moderate' ELSE 'Low' END AS density_level
    FROM points p LEFT JOIN near ON near.point_id = p.point_id LEFT JOIN cells c ON c.grid_id = near.grid_id LEFT JOIN predictions q ON q.grid_id = near.grid_id""")
def _(d):
    prof = C.point_profiles(d.points.select("point_id", "lon", "lat"), d.cells, d.predictions.select("grid_id", "predicted_lst"))
    return prof.select("point_id", "available", *r6("mean_lst", "predicted_lst"), "aqi_class", F.col("density_risk.level").alias("density_level"))


@query("attach_predictions_J26", "SELECT c.grid_id, R6(p.predicted_lst) AS predicted_lst, R6(p.predicted_lst - c.mean_lst) AS lst_residual FROM cells c LEFT JOIN predictions p ON p.grid_id = c.grid_id")
def _(d):
    return C.attach_predictions(d.cells, d.predictions.select("grid_id", "predicted_lst"), "mean_lst").select("grid_id", *r6("predicted_lst", "lst_residual"))


@query("date_comparison_J27", """
    SELECT a.grid_id, R6(a.lst_c) AS lst_a, R6(b.lst_c) AS lst_b, CASE WHEN b.lst_c - a.lst_c > 0.5 THEN 'warming' WHEN b.lst_c - a.lst_c < -0.5 THEN 'cooling' ELSE 'unchanged' END AS change
    FROM cell_two_dates a JOIN cell_two_dates b ON a.grid_id = b.grid_id AND a.side = 0 AND b.side = 1 WHERE a.lst_c IS NOT NULL AND b.lst_c IS NOT NULL""")
def _(d):
    t = d.cell_two_dates
    return TP.compare_dates(t.where("side = 0"), t.where("side = 1")).select("grid_id", *r6("lst_a", "lst_b"), "change")


CITY_BOX = (85.72, 20.08, 86.0, 20.5)


@query("scene_covers_boundary_J28", "SELECT scene_id FROM scenes WHERE xmin - 1e-7 <= 85.72e0 AND ymin - 1e-7 <= 20.08e0 AND xmax + 1e-7 >= 86.0e0 AND ymax + 1e-7 >= 20.5e0")
def _(d):
    return d.scenes.where(TP.footprint_covers(CITY_BOX)).select("scene_id")


@query("lattice_edges_J29", f"""
    WITH s AS (SELECT quantile_cont(mean_lst, 0.6) AS p60, stddev_pop(mean_lst) AS sd FROM cells),
    e AS (SELECT a.grid_id AS src, b.grid_id AS dst, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m, b.mean_lst AS lst
      FROM cells a JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) AS v(dx, dy) ON true JOIN cells b ON b.ix = a.ix + v.dx AND b.iy = a.iy + v.dy)
    SELECT src, count(*) AS edges, R3(sum(m)) AS metres, R3(sum(m * (1 + 0.28e0 * least(3.0e0, greatest(0.0e0, (lst - p60) / sd))))) AS cost FROM e, s GROUP BY src""")
def _(d):
    edges = S.lattice_edges(d.cells, "mean_lst", C.heat_stats(d.cells, "mean_lst"), 0.28)
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("edges"), round_even(F.sum("distance_m"), 3).alias("metres"), round_even(F.sum("cost"), 3).alias("cost"))


EXPLAIN_FEATURES = ["impervious_ratio", "mean_pm25", "mean_ndvi", "green_cover", "building_coverage_pct", "tree_density", "dist_to_park", "land_cover_class", "hvi"]
_LONG = " UNION ALL ".join(f"SELECT grid_id, '{c}' AS feature, {c} * 1.0e0 AS value FROM cells WHERE {c} IS NOT NULL" for c in EXPLAIN_FEATURES)
EXPLAIN_SQL = f"""
    WITH l AS ({_LONG}), m AS (SELECT feature, avg(value) AS city_mean, stddev_pop(value) / (max(value) - min(value)) AS importance FROM l GROUP BY feature),
    factors AS (SELECT grid_id, l.feature, value, city_mean, CASE WHEN value > city_mean THEN 'above' ELSE 'below' END AS direction,
      l.feature NOT IN ('mean_ndvi', 'green_cover', 'tree_density', 'green_to_built', 'dist_to_park') AS hotter_when_high, importance FROM l JOIN m ON m.feature = l.feature)
"""


def importance_table(d):
    from thermogrid.operators.stats import describe_columns

    stats = describe_columns(d.cells, EXPLAIN_FEATURES, {"s": lambda c: F.stddev_pop(c.cast("double")), "lo": lambda c: F.min(c.cast("double")), "hi": lambda c: F.max(c.cast("double"))})
    return stats.select(F.col("column").alias("feature"), (F.col("s") / (F.col("hi") - F.col("lo"))).alias("importance"))


@query("explain_cells_J30", EXPLAIN_SQL + "SELECT grid_id, feature, R3(value) AS value, R3(city_mean) AS city_mean, direction, hotter_when_high, R4(importance) AS importance FROM factors")
def _(d):
    out = C.explain_cells(d.cells, importance_table(d), EXPLAIN_FEATURES)
    return out.select("grid_id", "feature", round_even("value", 3).alias("value"), round_even("city_mean", 3).alias("city_mean"), "direction", "hotter_when_high", round_even("importance", 4).alias("importance"))


_PC = ("(3 * (85.7e0 + x0 / 104000.0e0) + 2 * (85.7e0 + x1 / 104000.0e0)) / 5", "(3 * (20.1e0 + y0 / 111000.0e0) + (20.1e0 + y1 / 111000.0e0) + (20.1e0 + (y0 + (y1 - y0) * 0.5e0) / 111000.0e0)) / 5")


@query("area_statistics_J31", f"""
    WITH p AS (SELECT CASE WHEN landuse IN ('forest', 'orchard') THEN 'green' WHEN landuse = 'railway' THEN 'water' ELSE 'building' END AS layer,
        CASE WHEN landuse = 'forest' THEN 'wood' END AS nat, {RING_AREA_SQL} AS m2, {hav('20.1511e0', '85.7507e0', _PC[1], _PC[0])} AS d FROM rects),
    r AS (SELECT {hav('20.1511e0', '85.7507e0', '20.1e0 + y1 / 111000.0e0', '85.7e0 + x1 / 104000.0e0')} AS d1, {hav('20.1511e0', '85.7507e0', '20.1e0 + y2 / 111000.0e0', '85.7e0 + x2 / 104000.0e0')} AS d2,
        {hav('(20.1e0 + y1 / 111000.0e0)', '(85.7e0 + x1 / 104000.0e0)', '(20.1e0 + y2 / 111000.0e0)', '(85.7e0 + x2 / 104000.0e0)')} AS m FROM segments)
    SELECT count(*) FILTER (layer = 'building') AS buildings, count(*) FILTER (layer = 'green') AS green_count, R0(coalesce(sum(m2) FILTER (layer = 'green'), 0)) AS green_area_m2,
      count(*) FILTER (layer = 'water') AS water_count, R0(coalesce(sum(m2) FILTER (layer = 'water'), 0)) AS water_area_m2, count(*) FILTER (layer = 'green' AND nat = 'wood') AS trees,
      (SELECT R1(sum(m)) FROM r WHERE d1 <= 2500 OR d2 <= 2500) AS road_length_m FROM p WHERE d <= 2500""")
def _(d):
    lu = F.col("landuse")
    polys = lonlat_ring(d).select("coords", F.when(lu.isin("forest", "orchard"), F.lit("green")).when(lu == "railway", F.lit("water")).otherwise(F.lit("building")).alias("layer"),
                                  F.when(lu == "forest", F.lit("Wood")).alias("natural"))
    lon, lat = (lambda c: 85.7 + F.col(c) / 104000.0), (lambda c: 20.1 + F.col(c) / 111000.0)
    roads = d.segments.select(lon("x1").alias("lon1"), lat("y1").alias("lat1"), lon("x2").alias("lon2"), lat("y2").alias("lat2"))
    return C.area_statistics(polys, roads, (85.7507, 20.1511), 2500.0)


@query("boundary_mask_J32", f"SELECT grid_id, CASE WHEN {pip_sql('lon', 'lat')} THEN R6(mean_aqi) END AS mean_aqi FROM cells")
def _(d):
    marked = S.mark_in_polygon(d.cells.select("grid_id", "lon", "lat", "mean_aqi"), "lon", "lat", OUTLINE)
    return marked.select("grid_id", F.when(F.col("inside"), round_even("mean_aqi", 6)).alias("mean_aqi"))


@query("enrich_hot_cells_J33", """
    SELECT grid_id, R2(mean_lst) AS mean_lst, R6(mean_ndvi) AS mean_ndvi, R6(green_cover) AS green_cover, R6(dist_to_park) AS dist_to_park FROM cells ORDER BY R2(mean_lst) DESC, grid_id LIMIT 50""")
def _(d):
    hot = C.hotspots(d.cells.select("grid_id", "mean_lst"), "mean_lst", 50)
    return C.enrich(hot, d.cells, ["mean_ndvi", "green_cover", "dist_to_park"]).select("grid_id", "mean_lst", *r6("mean_ndvi", "green_cover", "dist_to_park"))


def metric_sql(t: str) -> str:
    return (f"SELECT sqrt(avg(pow(predicted_lst - target_lst, 2))) AS rmse, avg(abs(predicted_lst - target_lst)) AS mae, "
            f"1 - sum(pow(predicted_lst - target_lst, 2)) / (var_pop(target_lst) * count(*)) AS r2 FROM {t}")


@query("model_comparison_J34", f"""
    WITH a AS ({metric_sql('predictions')}), b AS ({metric_sql('close_predictions')}),
    l AS (SELECT 'rmse' AS metric, a.rmse AS v1, b.rmse AS v2 FROM a, b UNION ALL SELECT 'mae', a.mae, b.mae FROM a, b UNION ALL SELECT 'r2', a.r2, b.r2 FROM a, b)
    SELECT metric, R5(v1) AS v1, R5(v2) AS v2, R5(CASE WHEN metric = 'r2' THEN v2 - v1 ELSE v1 - v2 END) AS improvement, CASE WHEN metric <> 'r2' THEN R2((v1 - v2) / v1 * 100) END AS improvement_pct,
      CASE WHEN (SELECT rmse FROM b) < (SELECT rmse FROM a) THEN 'DEPLOY_V2' ELSE 'KEEP_V1' END AS recommendation FROM l""")
def _(d):
    from thermogrid.operators.metrics import regression_metrics

    out = TP.compare_models(regression_metrics(d.predictions, "target_lst", "predicted_lst"), regression_metrics(d.close_predictions, "target_lst", "predicted_lst"))
    return out.select("metric", *[round_even(c, 5).alias(c) for c in ("v1", "v2", "improvement")], round_even("improvement_pct", 2).alias("improvement_pct"), "recommendation")


@query("align_raster_frames_J35", """
    WITH a AS (SELECT ix, iy, avg(lst_c) AS m, max(lst_c) AS x FROM lst_pixels WHERE lst_c IS NOT NULL GROUP BY ix, iy), b AS (SELECT ix, iy, avg(ndvi) AS m FROM ndvi_pixels WHERE ndvi IS NOT NULL GROUP BY ix, iy)
    SELECT c.grid_id, R6(a.m) AS lst_mean, R6(a.x) AS lst_max, R6(b.m) AS ndvi_mean FROM cells c LEFT JOIN a ON a.ix = c.ix AND a.iy = c.iy LEFT JOIN b ON b.ix = c.ix AND b.iy = c.iy""")
def _(d):
    a = RS.zonal_statistics(d.lst_pixels, ["ix", "iy"], "lst_c").select("ix", "iy", F.col("mean").alias("lst_mean"), F.col("max").alias("lst_max"))
    b = RS.zonal_statistics(d.ndvi_pixels, ["ix", "iy"], "ndvi").select("ix", "iy", F.col("mean").alias("ndvi_mean"))
    out = d.cells.select("grid_id", "ix", "iy").join(a, ["ix", "iy"], "left").join(b, ["ix", "iy"], "left")
    return out.select("grid_id", *r6("lst_mean", "lst_max", "ndvi_mean"))


@query("split_leakage_J36", """
    WITH t AS (SELECT grid_id, grid_id * 7919 % 100 < 60 AS test FROM cells)
    SELECT count(*) AS test_cells, count(*) FILTER (EXISTS (SELECT 1 FROM t u WHERE NOT u.test AND (u.grid_id = t.grid_id - 1 OR u.grid_id = t.grid_id + 1))) AS adjacent FROM t WHERE test""")
def _(d):
    from thermogrid.plans.models import split_leakage

    return split_leakage(d.cells.select("grid_id", (F.col("grid_id") * 7919 % 100 < 60).alias("is_test"))).select("test_cells", "adjacent")


@query("add_centroids_J37", "SELECT c.grid_id, R6(c.green_cover) AS green_cover, R6(c.lon) AS lon, R6(c.lat) AS lat FROM cells c")
def _(d):
    return d.cells.select("grid_id", "green_cover").join(d.cells.select("grid_id", "lon", "lat"), "grid_id", "left").select("grid_id", *r6("green_cover", "lon", "lat"))
