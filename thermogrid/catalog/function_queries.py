"""Text, date, geometry and scaling functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid import constants as K, functions as fn
from thermogrid.catalog.registry import query
from thermogrid.functions import round_even
from thermogrid.operators.keyed import attach_row
from thermogrid.operators.stats import scaled_columns
from thermogrid.plans import city as C


def r6(*names):
    return [round_even(n, 6).alias(n) for n in names]


@query("snake_case_F1", """
    SELECT p_partkey, lower(replace(regexp_replace(concat('Mean', upper(substr(p_name, 1, 1)), substr(p_name, 2), 'PctX', p_brand), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), ' ', '_')) AS name FROM part""")
def _(d):
    camel = F.concat(F.lit("Mean"), F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit("PctX"), F.col("p_brand"))
    return d.part.select("p_partkey", fn.snake_case(camel).alias("name"))


_SAFE = "lower(url)"
for _ch in " /\\:-":
    _SAFE = f"replace({_SAFE}, '{_ch}', '_')"
for _ch, _w in {"&": "and", "+": "plus", "@": "at", "#": "hash", "%": "pct", "=": "eq"}.items():
    _SAFE = f"replace({_SAFE}, '{_ch}', '{_w}')"
for _ch in ["''", '"', "(", ")", "[", "]", ",", ".", "?", "!", ";"]:
    _SAFE = f"replace({_SAFE}, '{_ch}', '')"


@query("safe_name_F2", f"SELECT page_id, {_SAFE} AS name FROM pages")
def _(d):
    return d.pages.select("page_id", fn.safe_name("url").alias("name"))


@query("label_slug_F3", r"SELECT page_id, regexp_replace(regexp_replace(url, '[ \-/_.]', '_', 'g'), '[^\p{L}\p{N}_]', '', 'g') AS slug FROM pages")
def _(d):
    return d.pages.select("page_id", fn.label_slug("url").alias("slug"))


@query("name_roles_F4", """
    WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat(p_name, '_ID') WHEN 1 THEN concat('MeanLst', p_brand) WHEN 2 THEN 'Grid_ID' WHEN 3 THEN 'the_geom' ELSE p_name END AS name FROM part)
    SELECT p_partkey, lower(name) LIKE '%lst%' AS is_target, lower(name) IN ('fid', 'objectid', 'index', 'grid_id') OR lower(name) LIKE '%\\_id' ESCAPE '\\' OR lower(name) LIKE '%.id' AS is_id,
      lower(name) IN ('geometry', 'geom', 'wkt', 'shape', 'the_geom') AS is_geometry FROM n""")
def _(d):
    k = F.col("p_partkey") % 5
    name = (F.when(k == 0, F.concat("p_name", F.lit("_ID"))).when(k == 1, F.concat(F.lit("MeanLst"), "p_brand"))
            .when(k == 2, F.lit("Grid_ID")).when(k == 3, F.lit("the_geom")).otherwise(F.col("p_name")))
    return d.part.select("p_partkey", fn.is_target_name(name).alias("is_target"), fn.is_id_name(name).alias("is_id"), fn.is_geometry_name(name).alias("is_geometry"))


@query("date_parsing_F5", "SELECT event_id, CAST(observed_at AS DATE) AS day, CAST(floor(epoch(observed_at)) AS BIGINT) AS epoch FROM observations")
def _(d):
    compact = F.date_format("observed_at", "yyyyMMdd")
    iso = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return d.observations.select("event_id", fn.compact_date(compact).alias("day"), F.unix_timestamp(fn.iso_timestamp(iso)).alias("epoch"))


@query("month_period_days_F6", """
    SELECT date, month(date) AS month, CAST(date_trunc('month', date) AS DATE) AS period, date_diff('day', DATE '1996-02-10', date) AS days FROM weather_long""")
def _(d):
    return d.weather_long.select("date", F.month("date").alias("month"), fn.month_start("date").alias("period"), F.datediff("date", F.lit("1996-02-10").cast("date")).alias("days"))


@query("span_years_F7", """
    SELECT o_custkey, R1(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25e0) AS years FROM orders GROUP BY o_custkey""")
def _(d):
    spans = d.orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return spans.select("o_custkey", fn.span_years("a", "b").alias("years"))


@query("unix_timestamp_F8", "SELECT grid_id, strftime(make_timestamp((1700000000 + grid_id * 37) * 1000000), '%Y-%m-%d %H:%M:%S') AS observed_at FROM cells")
def _(d):
    at = fn.unix_to_timestamp(F.lit(1700000000) + F.col("grid_id") * 37)
    return d.cells.select("grid_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("observed_at"))


def hav(lat1, lon1, lat2, lon2):
    return (f"(2 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")


@query("haversine_F9", f"SELECT grid_id, R4({hav('lat', 'lon', '20.25e0', '85.78e0')}) AS metres FROM cells")
def _(d):
    return d.cells.select("grid_id", round_even(fn.haversine_m("lat", "lon", F.lit(20.25), F.lit(85.78)), 4).alias("metres"))


def lonlat_ring(d):
    """Each box of `rects` as a closed lon/lat ring with a cut corner."""
    lon, lat = (lambda e: 85.7 + e / 104000.0), (lambda e: 20.1 + e / 111000.0)
    c = F.col
    pts = [(c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y0") + (c("y1") - c("y0")) * 0.5), (c("x0"), c("y0"))]
    return d.rects.select("rect_id", "kind", "landuse", F.array(*[F.struct(lon(x).alias("x"), lat(y).alias("y")) for x, y in pts]).alias("coords"))


M2 = f"{K.M_PER_DEG_LNG!r}e0 * {K.M_PER_DEG_LAT!r}e0"
RING_AREA_SQL = f"abs((x1 - x0) * (y1 - y0) - (x1 - x0) * (y1 - y0) * 0.25e0) / 104000.0e0 / 111000.0e0 * {M2}"


@query("polygon_area_F10", f"SELECT rect_id, R2({RING_AREA_SQL}) AS area_m2 FROM rects")
def _(d):
    return lonlat_ring(d).select("rect_id", round_even(fn.polygon_area_m2("coords"), 2).alias("area_m2"))


LON, LAT = "(85.7e0 + {} / 104000.0e0)", "(20.1e0 + {} / 111000.0e0)"
SEG_LEN_SQL = hav(LAT.format("y1"), LON.format("x1"), LAT.format("y1"), LON.format("x2")) + " + " + hav(LAT.format("y1"), LON.format("x2"), LAT.format("y2"), LON.format("x2"))


@query("polyline_length_F11", f"SELECT segment_id, R4({SEG_LEN_SQL}) AS length_m FROM segments")
def _(d):
    from thermogrid.catalog.sources_queries import _line

    return _line(d).select("segment_id", round_even(fn.polyline_length_m("coords"), 4).alias("length_m"))


@query("vertex_centroid_F12", """
    SELECT rect_id, R6((3 * (85.7e0 + x0 / 104000.0e0) + 2 * (85.7e0 + x1 / 104000.0e0)) / 5) AS lon,
      R6((3 * (20.1e0 + y0 / 111000.0e0) + (20.1e0 + y1 / 111000.0e0) + (20.1e0 + (y0 + (y1 - y0) * 0.5e0) / 111000.0e0)) / 5) AS lat FROM rects""")
def _(d):
    c = fn.vertex_centroid("coords")
    return lonlat_ring(d).select("rect_id", round_even(c["x"], 6).alias("lon"), round_even(c["y"], 6).alias("lat"))


@query("flatten_positions_F13", """
    SELECT rect_id, CASE rect_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS n,
      R4(CASE rect_id % 4 WHEN 0 THEN x0 WHEN 1 THEN x0 + x1 WHEN 2 THEN x0 + x1 + x1 ELSE x0 + x1 + x1 + x0 END) AS sum_x FROM rects""")
def _(d):
    p = lambda a, b: F.array(F.col(a), F.col(b))
    k = F.col("rect_id") % 4
    kind = F.when(k == 0, F.lit("Point")).when(k == 1, F.lit("LineString")).when(k == 2, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    text = (F.when(k == 0, F.to_json(p("x0", "y0"))).when(k == 1, F.to_json(F.array(p("x0", "y0"), p("x1", "y0"))))
            .when(k == 2, F.to_json(F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1")))))
            .otherwise(F.to_json(F.array(F.array(F.array(p("x0", "y0"), p("x1", "y0"))), F.array(F.array(p("x1", "y1"), p("x0", "y1")))))))
    flat = d.rects.select("rect_id", kind.alias("kind"), text.alias("text")).withColumn("p", fn.flatten_positions("kind", "text"))
    return flat.select("rect_id", F.size("p").alias("n"), round_even(F.aggregate("p", F.lit(0.0), lambda a, q: a + q["x"]), 4).alias("sum_x"))


def utm_sql() -> str:
    """Forward transverse Mercator with the same published series, written out in SQL."""
    from thermogrid.functions import geo as g

    n = "xi" + "".join(f" + ({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(g._ALPHA, start=1))
    e = "eta" + "".join(f" + ({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(g._ALPHA, start=1))
    sc = g._K0 * g._RECT
    return f"""
    WITH a AS (SELECT grid_id, lon, lat, sin(radians(lat)) AS s, radians(lon) - radians(87.0e0) AS lam FROM cells),
    t AS (SELECT *, sinh(atanh(s) - {g._ECC!r} * atanh({g._ECC!r} * s)) AS t FROM a),
    x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT grid_id, R3(500000.0e0 + {sc!r} * ({e})) AS easting, R3({sc!r} * ({n})) AS northing, R6(lon) AS lon, R6(lat) AS lat FROM x"""


@query("utm_round_trip_F14", utm_sql())
def _(d):
    there = d.cells.select("grid_id", "lon", "lat", fn.utm_forward("lon", "lat").alias("u"))
    back = there.select("grid_id", "lon", "lat", "u", fn.utm_inverse("u.x", "u.y").alias("b"))
    return back.select("grid_id", round_even("u.x", 3).alias("easting"), round_even("u.y", 3).alias("northing"), round_even("b.x", 6).alias("lon"), round_even("b.y", 6).alias("lat"))


@query("utm_epsg_F15", """
    SELECT point_id, CASE WHEN y / 60.0e0 - 100 >= 0 THEN 32600 ELSE 32700 END + CAST(floor((x / 12000.0e0 * 360 - 180 + 180.0e0) / 6) AS INT) + 1 AS epsg FROM points""")
def _(d):
    return d.points.select("point_id", fn.utm_epsg(F.col("x") / 12000.0 * 360 - 180, F.col("y") / 60.0 - 100).alias("epsg"))


@query("tile_keys_F16", """
    SELECT grid_id, CAST(floor((lon + 180.0e0) / 360.0e0 * 16384) AS BIGINT) AS tile_x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS tile_y,
      concat('Copernicus_DSM_COG_10_', CASE WHEN lat - 21 >= 0 THEN 'N' ELSE 'S' END, lpad(CAST(abs(CAST(floor(lat - 21) AS INT)) AS VARCHAR), 2, '0'), '_00_E', lpad(CAST(CAST(floor(lon) AS INT) AS VARCHAR), 3, '0'), '_00_DEM') AS dem_tile
    FROM cells""")
def _(d):
    key = fn.degree_tile_key("lon", F.col("lat") - 21)
    return d.cells.select("grid_id", F.floor(fn.mercator_tile_x("lon", 14)).alias("tile_x"), F.floor(fn.mercator_tile_y("lat", 14)).alias("tile_y"),
                          fn.degree_tile_name(key["lat0"], key["lon0"]).alias("dem_tile"))


@query("metres_per_degree_F17", "SELECT grid_id, R6(111320.0e0 * cos(radians(lat))) AS per_x, R6(111132.0e0 - 559.0e0 * cos(2 * radians(lat))) AS per_y FROM cells")
def _(d):
    px, py = fn.metres_per_degree("lat")
    return d.cells.select("grid_id", round_even(px, 6).alias("per_x"), round_even(py, 6).alias("per_y"))


@query("safe_divide_F18", "SELECT grid_id, R6(CASE WHEN tree_count <> 0 THEN green_cover / tree_count END) AS ratio, R6(CASE WHEN tree_count <> 0 THEN green_cover / tree_count ELSE -1.0e0 END) AS filled FROM cells")
def _(d):
    return d.cells.select("grid_id", round_even(fn.safe_divide("green_cover", "tree_count"), 6).alias("ratio"), round_even(fn.safe_divide("green_cover", "tree_count", -1.0), 6).alias("filled"))


@query("heat_edge_cost_F19", """
    WITH s AS (SELECT quantile_cont(mean_lst, 0.6) AS p60, stddev_pop(mean_lst) AS sd FROM cells)
    SELECT grid_id, R4(100.0e0 * (1 + 0.28e0 * least(3.0e0, greatest(0.0e0, (mean_lst - p60) / sd)))) AS cost FROM cells, s""")
def _(d):
    marked = attach_row(d.cells, "_s", C.heat_stats(d.cells, "mean_lst"))
    return marked.select("grid_id", round_even(fn.edge_cost(F.lit(100.0), "mean_lst", F.col("_s.p60"), F.col("_s.std"), 0.28), 4).alias("cost"))


@query("json_record_F20", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AND value > 1 AS complete FROM observations""")
def _(d):
    rec = F.from_json("props", "k bigint, missing string")
    return d.observations.select("event_id", rec["k"].alias("k"), (rec["k"].isNotNull() & (F.col("value") > 1)).alias("complete"))


@query("min_max_scale_N1", """
    SELECT grid_id, R6((mean_lst - (SELECT min(mean_lst) FROM cells)) / ((SELECT max(mean_lst) FROM cells) - (SELECT min(mean_lst) FROM cells))) AS scaled, 0.5e0 AS flat FROM cells""")
def _(d):
    bounds = d.cells.agg(F.min("mean_lst").alias("lo"), F.max("mean_lst").alias("hi"), F.min(F.lit(7.0)).alias("flat"))
    m = attach_row(d.cells, "_b", bounds)
    return m.select("grid_id", round_even(fn.min_max_scale("mean_lst", F.col("_b.lo"), F.col("_b.hi")), 6).alias("scaled"),
                    fn.min_max_scale(F.lit(7.0), F.col("_b.flat"), F.col("_b.flat")).alias("flat"))


@query("z_score_N2", """
    SELECT grid_id, CASE WHEN mean_ndvi IS NOT NULL THEN R6((mean_ndvi - (SELECT avg(mean_ndvi) FROM cells)) / (SELECT stddev_pop(mean_ndvi) FROM cells)) END AS mean_ndvi,
      R6((mean_lst - (SELECT avg(mean_lst) FROM cells)) / (SELECT stddev_pop(mean_lst) FROM cells)) AS mean_lst FROM cells""")
def _(d):
    return scaled_columns(d.cells.select("grid_id", "mean_ndvi", "mean_lst"), ["mean_ndvi", "mean_lst"]).select("grid_id", *r6("mean_ndvi", "mean_lst"))
