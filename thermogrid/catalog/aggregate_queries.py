"""Aggregates and distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid import constants as K, functions as fn
from thermogrid.catalog.function_queries import lonlat_ring, RING_AREA_SQL, SEG_LEN_SQL
from thermogrid.catalog.join_queries import LINE_SQL, POINT_COUNT_SQL, _OVER, touch, temporal, TEMPORAL_SQL
from thermogrid.catalog.registry import query
from thermogrid.catalog.scalar_queries import COMPOSITE_SQL, NOAA_SQL
from thermogrid.functions import round_even
from thermogrid.operators import metrics as M, raster as RS, series as SR, spatial as S, stats as ST
from thermogrid.operators.keyed import drop_duplicate_rows
from thermogrid.plans import city as C, scenario as SC, temporal as TP


SEASON_SQL = "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'pre_monsoon' WHEN month(date) IN (6, 7, 8, 9) THEN 'monsoon' ELSE 'post_monsoon' END"


def r6(*names):
    return [round_even(n, 6).alias(n) for n in names]


def r4(*names):
    return [round_even(n, 4).alias(n) for n in names]


def sel(df, *keep, digits=6):
    """Round every double column, keep the rest."""
    types = dict(df.dtypes)
    return df.select(*[round_even(c, digits).alias(c) if types[c] == "double" else F.col(c) for c in (keep or df.columns)])


NUM = ["mean_ndvi", "green_cover", "tree_count", "dist_to_water", "road_density", "mean_aqi", "mean_lst"]


def per_column(template: str, columns=NUM, table: str = "cells") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {template.replace('{c}', c)} FROM {table}" for c in columns)


@query("zonal_statistics_A1", """
    WITH z AS (SELECT ix, iy, avg(lst_c) AS mean, sum(lst_c) AS s, min(lst_c) AS lo, max(lst_c) AS hi FROM lst_pixels WHERE lst_c IS NOT NULL GROUP BY ix, iy)
    SELECT c.grid_id, R6(mean) AS mean, R6(s) AS "sum", R6(lo) AS "min", R6(hi) AS "max" FROM cells c LEFT JOIN z ON z.ix = c.ix AND z.iy = c.iy""")
def _(d):
    z = RS.zonal_statistics(d.lst_pixels, ["ix", "iy"], "lst_c")
    return sel(d.cells.select("grid_id", "ix", "iy").join(z, ["ix", "iy"], "left"), "grid_id", "mean", "sum", "min", "max")


_CIRC = "((degrees(atan2(coalesce(sum(sin(radians(angle))), 0.0e0), coalesce(sum(cos(radians(angle))), 0.0e0))) + 360) % 360)"


@query("circular_mean_A2", f"SELECT c.grid_id, R4({_CIRC}) AS aspect FROM cells c LEFT JOIN pixels p ON p.ix = c.ix AND p.iy = c.iy GROUP BY c.grid_id")
def _(d):
    joined = d.cells.select("grid_id", "ix", "iy").join(d.pixels.select("ix", "iy", "angle"), ["ix", "iy"], "left")
    return joined.groupBy("grid_id").agg(round_even(RS.circular_mean("angle"), 4).alias("aspect"))


MAJORITY_SQL = """
    WITH n AS (SELECT ix, iy, class_code, count(*) AS c FROM pixels WHERE class_code IS NOT NULL GROUP BY ix, iy, class_code),
    m AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY c DESC, class_code) AS rn, sum(c) OVER (PARTITION BY ix, iy) AS t FROM n)
    SELECT ix, iy, min(CASE WHEN rn = 1 THEN class_code END) AS majority, R4(coalesce(sum(CASE WHEN class_code = 1 THEN c END), 0) / min(t) * 100) AS share_1,
      R4(coalesce(sum(CASE WHEN class_code = 2 THEN c END), 0) / min(t) * 100) AS share_2 FROM m GROUP BY ix, iy"""


@query("majority_class_A3", MAJORITY_SQL)
def _(d):
    return sel(RS.majority_class(d.pixels, ["ix", "iy"], "class_code", [1, 2]), digits=4)


@query("composed_aggregates_X3", f"""
    WITH maj AS ({MAJORITY_SQL}), c AS (SELECT ix, iy, {_CIRC} AS aspect FROM pixels GROUP BY ix, iy)
    SELECT c.ix, c.iy, maj.majority, R4(c.aspect) AS aspect FROM c LEFT JOIN maj ON maj.ix = c.ix AND maj.iy = c.iy""")
def _(d):
    m = RS.majority_class(d.pixels, ["ix", "iy"], "class_code", [])
    c = d.pixels.groupBy("ix", "iy").agg(round_even(RS.circular_mean("angle"), 4).alias("aspect"))
    return c.join(m, ["ix", "iy"], "left").select("ix", "iy", "majority", "aspect")


@query("building_block_A4", f"""
    WITH b AS (SELECT tx.ix, ty.iy, count(*) AS n, sum({_OVER}) AS area, avg((x1 - x0) * (y1 - y0)) AS foot FROM rects, {touch('x0', 'y0', 'x1', 'y1')} GROUP BY tx.ix, ty.iy)
    SELECT c.grid_id, coalesce(n, 0) AS building_count, R4(coalesce(n, 0) / 0.01e0) AS building_density, R4(coalesce(area, 0.0e0) / 10000.0e0 * 100) AS building_coverage_pct, R4(coalesce(foot, 0.0e0)) AS avg_footprint
    FROM cells c LEFT JOIN b ON b.ix = c.ix AND b.iy = c.iy""")
def _(d):
    b = S.rect_overlap_per_cell(d.rects)
    j = d.cells.select("grid_id", "ix", "iy").join(b, ["ix", "iy"], "left").na.fill({"touching": 0, "area": 0.0, "mean_footprint": 0.0})
    return j.select("grid_id", F.col("touching").alias("building_count"), round_even(F.col("touching") / 0.01, 4).alias("building_density"),
                    round_even(F.col("area") / 10000.0 * 100, 4).alias("building_coverage_pct"), round_even("mean_footprint", 4).alias("avg_footprint"))


def nodes_sql(table: str) -> str:
    """Nodes of all pieces of a table by comparing every two of them: n(x, y, pieces)."""
    return f"""
    pr AS (SELECT a.x1 AS ax1, a.y1 AS ay1, a.x2 - a.x1 AS ax, a.y2 - a.y1 AS ay, b.x2 - b.x1 AS bx, b.y2 - b.y1 AS by_, b.x1 - a.x1 AS gx, b.y1 - a.y1 AS gy
      FROM {table} a JOIN {table} b ON a.segment_id < b.segment_id AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) + 0.01e0 AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 0.01e0
        AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) + 0.01e0 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 0.01e0),
    tu AS (SELECT *, (gx * by_ - gy * bx) / (ax * by_ - ay * bx) AS t, (gx * ay - gy * ax) / (ax * by_ - ay * bx) AS u FROM pr WHERE ax * by_ - ay * bx <> 0),
    pt AS (SELECT x1 AS x, y1 AS y FROM {table} UNION ALL SELECT x2, y2 FROM {table} UNION ALL
      SELECT ax1 + t * ax, ay1 + t * ay FROM tu WHERE t BETWEEN -1e-9 AND 1 + 1e-9 AND u BETWEEN -1e-9 AND 1 + 1e-9),
    nd AS (SELECT DISTINCT round_even(x * 1000.0e0, 0) / 1000.0e0 AS x, round_even(y * 1000.0e0, 0) / 1000.0e0 AS y FROM pt),
    hit AS (SELECT nd.x, nd.y, s.x1, s.y1, s.x2, s.y2,
        least(1.0e0, greatest(0.0e0, ((nd.x - s.x1) * (s.x2 - s.x1) + (nd.y - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)))) AS f
      FROM nd JOIN {table} s ON nd.x BETWEEN least(s.x1, s.x2) - 0.01e0 AND greatest(s.x1, s.x2) + 0.01e0 AND nd.y BETWEEN least(s.y1, s.y2) - 0.01e0 AND greatest(s.y1, s.y2) + 0.01e0
      WHERE s.x1 <> s.x2 OR s.y1 <> s.y2),
    oni AS (SELECT * FROM hit WHERE sqrt(pow(x1 + f * (x2 - x1) - x, 2) + pow(y1 + f * (y2 - y1) - y, 2)) <= 0.001e0),
    w AS (SELECT x, y, x1 - x AS dx, y1 - y AS dy FROM oni UNION ALL SELECT x, y, x2 - x, y2 - y FROM oni),
    dw AS (SELECT DISTINCT x, y, round_even(dx / sqrt(dx * dx + dy * dy) * 1e4, 0) + 0.0e0 AS a, round_even(dy / sqrt(dx * dx + dy * dy) * 1e4, 0) + 0.0e0 AS b FROM w WHERE sqrt(dx * dx + dy * dy) > 0.002e0),
    n AS (SELECT x, y, count(*) AS pieces FROM dw GROUP BY x, y HAVING count(*) >= 3)"""


@query("road_block_A5", LINE_SQL + """,
    roads AS (SELECT ix, iy, sum(length) AS length FROM lengths WHERE trim(highway) NOT IN ('footway', 'path', 'cycleway', 'steps', 'track') GROUP BY ix, iy),
    m AS (SELECT segment_id, x1, y1, x2, y2 FROM segments WHERE trim(highway) NOT IN ('footway', 'path', 'cycleway', 'steps', 'track')),""" + nodes_sql("m") + """,
    k AS (SELECT CAST(floor(x / 100) AS BIGINT) AS ix, CAST(floor(y / 100) AS BIGINT) AS iy, count(*) AS n FROM n GROUP BY 1, 2)
    SELECT c.grid_id, R4(coalesce(length, 0.0e0)) AS road_length, R4(coalesce(length, 0.0e0) / 0.01e0) AS road_density, coalesce(k.n, 0) AS junctions, R4(coalesce(k.n, 0) / 0.01e0) AS junction_density
    FROM cells c LEFT JOIN roads r ON r.ix = c.ix AND r.iy = c.iy LEFT JOIN k ON k.ix = c.ix AND k.iy = c.iy""")
def _(d):
    motor = d.segments.where(fn.is_motor_road("highway"))
    r, k = S.line_length_per_cell(motor), S.count_per_cell(S.network_nodes(motor), "x", "y")
    length, n = F.coalesce(F.col("length"), F.lit(0.0)), F.coalesce(F.col("n"), F.lit(0))
    out = d.cells.select("grid_id", "ix", "iy").join(r, ["ix", "iy"], "left").join(k, ["ix", "iy"], "left")
    return out.select("grid_id", round_even(length, 4).alias("road_length"), round_even(length / 0.01, 4).alias("road_density"), n.alias("junctions"), round_even(n / 0.01, 4).alias("junction_density"))


def street_grid(d):
    """Pieces across, along and slanted that start on a coarse raster, so that they meet at ends, inside, and lie on each other."""
    k = F.col("p_partkey")
    x, y = (k * 7919 % 110) * 100.0, (k * 104729 % 113) * 100.0
    x2 = F.when(k % 3 == 1, x).otherwise(x + 300.0)
    y2 = F.when(k % 3 == 0, y).when(k % 3 == 1, y + 300.0).otherwise(y + 200.0)
    return d.part.select(k.alias("segment_id"), x.alias("x1"), y.alias("y1"), x2.alias("x2"), y2.alias("y2"))


STREET_SQL = """
    WITH b AS (SELECT p_partkey AS segment_id, (p_partkey * 7919 % 110) * 100.0e0 AS x1, (p_partkey * 104729 % 113) * 100.0e0 AS y1, p_partkey % 3 AS h FROM part),
    st AS (SELECT segment_id, x1, y1, CASE WHEN h = 1 THEN x1 ELSE x1 + 300 END AS x2, CASE WHEN h = 0 THEN y1 WHEN h = 1 THEN y1 + 300 ELSE y1 + 200 END AS y2 FROM b)
"""


@query("road_junctions_A6", STREET_SQL + "," + nodes_sql("st") + " SELECT x, y, pieces FROM n")
def _(d):
    return S.network_nodes(street_grid(d))


@query("tree_and_green_block_A7", f"""
    WITH t AS ({POINT_COUNT_SQL}), g AS (SELECT tx.ix, ty.iy, sum({_OVER}) AS area FROM rects, {touch('x0', 'y0', 'x1', 'y1')} GROUP BY tx.ix, ty.iy)
    SELECT c.grid_id, coalesce(t.n, 0) AS tree_count, R4(coalesce(t.n, 0) / 0.01e0) AS tree_density, R4(least(100.0e0, coalesce(g.area, 0.0e0) / 5000.0e0 * 100)) AS green_space_pct
    FROM cells c LEFT JOIN t ON t.ix = c.ix AND t.iy = c.iy LEFT JOIN g ON g.ix = c.ix AND g.iy = c.iy""")
def _(d):
    t, g = S.count_per_cell(d.points, "x", "y"), S.rect_overlap_per_cell(d.rects).select("ix", "iy", "area")
    n, area = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("area"), F.lit(0.0))
    j = d.cells.select("grid_id", "ix", "iy").join(t, ["ix", "iy"], "left").join(g, ["ix", "iy"], "left")
    return j.select("grid_id", n.alias("tree_count"), round_even(n / 0.01, 4).alias("tree_density"), round_even(fn.clip(area / 5000.0 * 100, 0.0, 100.0), 4).alias("green_space_pct"))


@query("monthly_means_A8", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, R6(avg(t2m)) AS t2m, R6(avg(ws2m)) AS ws2m FROM weather_long GROUP BY 1")
def _(d):
    m = SR.monthly_means(d.weather_long.withColumn("site", F.lit("city")), ["site"], "date", ["t2m", "ws2m"])
    return sel(m, "month", "t2m", "ws2m")


@query("monthly_climatology_A9", "SELECT CAST(m.m AS INT) AS month, R4(t) AS t2m FROM range(1, 13) m(m) LEFT JOIN (SELECT month(date) AS k, avg(t2m) AS t FROM weather_daily GROUP BY 1) q ON q.k = m.m")
def _(d):
    return sel(SR.monthly_climatology(d.weather_daily, "date", ["t2m"]), digits=4)


@query("seasonal_climatology_A10", """
    SELECT s.s AS season, R4(t) AS t2m FROM (VALUES ('DJF'), ('MAM'), ('JJA'), ('SON')) s(s) LEFT JOIN (
      SELECT CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) IN (3, 4, 5) THEN 'MAM' WHEN month(date) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS k, avg(t2m) AS t FROM weather_daily GROUP BY 1) q ON q.k = s.s""")
def _(d):
    return sel(SR.seasonal_climatology(d.weather_daily, "date", ["t2m"]), digits=4)


@query("daily_describe_A11", per_column("R6(avg({c})) AS mean, R6(max({c})) AS \"max\", R6(min({c})) AS \"min\", R6(stddev_samp({c})) AS std, count(*) - count({c}) AS missing_days", ["t2m", "rh2m", "ws2m"], "weather_long"))
def _(d):
    return sel(ST.describe_columns(d.weather_long, ["t2m", "rh2m", "ws2m"], {
        "mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "missing_days": lambda c: F.count_if(c.isNull())}))


@query("hot_days_A12", NOAA_SQL + "SELECT site, count(*) FILTER (heat_index > 35) AS above_35, count(*) FILTER (heat_index > 40) AS above_40 FROM heat GROUP BY site")
def _(d):
    h = d.weather_daily.withColumn("h", fn.heat_index_noaa("t2m", "rh2m"))
    return h.groupBy("site").agg(F.count_if(F.col("h") > 35).alias("above_35"), F.count_if(F.col("h") > 40).alias("above_40"))


@query("feature_statistics_A13", per_column("count({c}) AS \"count\", R6(avg({c})) AS mean, R6(stddev_pop({c})) AS std, R6(min({c})) AS \"min\", R6(quantile_cont({c}, 0.25)) AS p25, R6(quantile_cont({c}, 0.5)) AS median, R6(quantile_cont({c}, 0.75)) AS p75, R6(max({c})) AS \"max\""))
def _(d):
    return sel(ST.feature_statistics(d.cells, NUM))


@query("data_ranges_A14", per_column("R6(min({c})) AS \"min\", R6(max({c})) AS \"max\", R6(avg({c})) AS mean, R6(stddev_pop({c})) AS std"))
def _(d):
    return sel(ST.describe_columns(d.cells, NUM, {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}))


@query("missing_report_A15", per_column("count(*) - count({c}) AS missing_count, R4((count(*) - count({c})) * 100.0e0 / count(*)) AS missing_pct"))
def _(d):
    return sel(ST.missing_report(d.cells, NUM), digits=4)


@query("fill_values_A16", """
    SELECT 'mean_ndvi' AS "column", R6(quantile_cont(mean_ndvi, 0.5)) AS fill FROM cells UNION ALL SELECT 'mean_aqi', R6(quantile_cont(mean_aqi, 0.5)) FROM cells UNION ALL
    SELECT 'class_code', mode * 1.0e0 FROM (SELECT class_code AS mode, count(*) AS n FROM pixels WHERE class_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, class_code LIMIT 1) q""")
def _(d):
    return sel(ST.median_fill_values(d.cells, ["mean_ndvi", "mean_aqi"]).unionByName(ST.mode_fill_values(d.pixels, ["class_code"])))


CORR = ["mean_ndvi", "green_cover", "impervious_ratio", "dist_to_water", "mean_lst"]
_PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1:]]


@query("correlation_matrix_A17", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", R6(corr({a}, {b})) AS corr FROM cells" for a, b in _PAIRS))
def _(d):
    return sel(ST.correlation_matrix(d.cells, CORR))


@query("leakage_screen_A18", """
    SELECT 'max_copy' AS "column", R4(abs(corr(mean_lst * 2 + 1, mean_lst))) AS abs_corr FROM cells""")
def _(d):
    wide = d.cells.select("mean_ndvi", "green_cover", "hvi", (F.col("mean_lst") * 2 + 1).alias("max_copy"), "mean_lst")
    c = ST.correlation_with_target(wide, ["mean_ndvi", "green_cover", "hvi", "max_copy"], "mean_lst").withColumn("abs_corr", F.abs("corr"))
    return c.where(F.col("abs_corr") > K.LEAKAGE_CORRELATION).select("column", *r4("abs_corr"))


@query("constant_columns_A19", """
    SELECT c AS "column" FROM (SELECT 'flat' AS c, count(DISTINCT CASE WHEN mean_ndvi IS NOT NULL THEN 5 END) AS n FROM cells UNION ALL SELECT 'empty', 0 FROM cells HAVING true
      UNION ALL SELECT 'green_cover', count(DISTINCT green_cover) FROM cells UNION ALL SELECT 'mean_ndvi', count(DISTINCT mean_ndvi) FROM cells) q WHERE n <= 1""")
def _(d):
    wide = d.cells.select("green_cover", "mean_ndvi", F.when(F.col("mean_ndvi").isNotNull(), F.lit(5.0)).alias("flat"), F.lit(None).cast("double").alias("empty"))
    return ST.constant_columns(wide, ["green_cover", "mean_ndvi", "flat", "empty"])


@query("duplicate_columns_A20", """
    SELECT c AS "column", f AS duplicate_of FROM (SELECT 'copy' AS c, 'green_cover' AS f, bool_and(green_cover IS NOT DISTINCT FROM green_cover * 1.0e0) AS same FROM cells
      UNION ALL SELECT 'ndvi_copy', 'mean_ndvi', bool_and(mean_ndvi IS NOT DISTINCT FROM mean_ndvi + 0.0e0) FROM cells UNION ALL SELECT 'hvi', 'green_cover', bool_and(hvi IS NOT DISTINCT FROM green_cover) FROM cells) q WHERE same""")
def _(d):
    wide = d.cells.select("green_cover", "mean_ndvi", "hvi", F.col("green_cover").alias("copy"), F.col("mean_ndvi").alias("ndvi_copy"))
    return ST.duplicate_columns(wide, wide.columns)


@query("column_roles_A21", """
    SELECT * FROM (SELECT 'grid_id' AS "column", CASE WHEN count(DISTINCT grid_id) = count(*) THEN 'id' ELSE 'numeric' END AS role FROM cells UNION ALL
    SELECT 'land_cover_class', CASE WHEN count(DISTINCT land_cover_class) <= 12 THEN 'categorical' ELSE 'numeric' END FROM cells UNION ALL SELECT 'ix', CASE WHEN count(DISTINCT ix) <= 12 THEN 'categorical' ELSE 'numeric' END FROM cells UNION ALL
    SELECT 'green_cover', 'numeric' UNION ALL SELECT 'season', 'categorical' UNION ALL SELECT 'mean_lst', 'target') q""")
def _(d):
    wide = d.cells.select("grid_id", "land_cover_class", "ix", "green_cover", F.lit("winter").alias("season"), "mean_lst")
    return ST.column_roles(wide, "mean_lst", [])


@query("scene_statistics_A22", """
    SELECT scene_key, count(lst_c) AS n, R4(avg(lst_c)) AS mean, R4(quantile_cont(lst_c, 0.5)) AS median, R4(min(lst_c)) AS "min", R4(max(lst_c)) AS "max", R4(stddev_pop(lst_c)) AS std,
      R4(quantile_cont(lst_c, 0.05)) AS p5, R4(quantile_cont(lst_c, 0.95)) AS p95 FROM lst_pixels GROUP BY scene_key""")
def _(d):
    px = d.lst_pixels
    basic = px.groupBy("scene_key").agg(F.count("lst_c").alias("n"), F.avg("lst_c").alias("mean"), F.min("lst_c").alias("min"), F.max("lst_c").alias("max"), F.stddev_pop("lst_c").alias("std"))
    q = ST.exact_quantiles(px, ["lst_c"], [0.05, 0.5, 0.95], by=["scene_key"]).select("scene_key", "q")
    out = basic.join(q, "scene_key", "left").select("scene_key", "n", "mean", F.col("q")[1].alias("median"), "min", "max", "std", F.col("q")[0].alias("p5"), F.col("q")[2].alias("p95"))
    return sel(out, digits=4)


_VD = "CASE WHEN ndvi IS NULL THEN 0 WHEN ndvi >= 0.6e0 THEN 5 WHEN ndvi >= 0.4e0 THEN 4 WHEN ndvi >= 0.2e0 THEN 3 WHEN ndvi >= 0.1e0 THEN 2 ELSE 1 END"


@query("class_area_table_A23", f"""
    WITH c AS (SELECT {_VD} AS k, ndvi FROM ndvi_pixels), t AS (SELECT count(*) AS t FROM c WHERE k > 0)
    SELECT CAST(l.k AS INT) AS "class", l.label, count(c.k) AS pixels, R4(count(c.k) * 100.0e0 / min(t.t)) AS percent, R4(count(c.k) * 0.01e0) AS area_ha, R4(count(c.k) * 0.0001e0) AS area_km2, R4(min(ndvi)) AS value_min, R4(max(ndvi)) AS value_max
    FROM (VALUES (1, 'Very Low'), (2, 'Low'), (3, 'Moderate'), (4, 'High'), (5, 'Very High')) l(k, label) CROSS JOIN t LEFT JOIN c ON c.k = l.k GROUP BY l.k, l.label""")
def _(d):
    classed = d.ndvi_pixels.withColumn("cls", fn.veg_density_class("ndvi"))
    labels = {i + 1: v for i, v in enumerate(K.VEG_DENSITY_LABELS)}
    return sel(ST.class_area_table(classed, "cls", labels, 100.0, "ndvi"), digits=4)


def hist_sql(table: str, col: str, bins: int) -> str:
    return f"""
    WITH s AS (SELECT min({col}) AS lo, max({col}) AS hi FROM {table}),
    b AS (SELECT CAST(least(floor(({col} - lo) / ((hi - lo) / {bins}.0e0)), {bins - 1}) AS INT) AS bin, count(*) AS n FROM {table}, s WHERE {col} IS NOT NULL GROUP BY 1)
    SELECT CAST(r.i AS INT) AS bin, R4(lo + (r.i + 0.5e0) * ((hi - lo) / {bins}.0e0)) AS mid, coalesce(b.n, 0) AS n FROM range({bins}) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = r.i"""


@query("histogram_A24", hist_sql("cells", "mean_aqi", 24))
def _(d):
    return sel(ST.histogram(d.cells, "mean_aqi", 24), digits=4)


@query("degree_distribution_A25", """
    WITH v AS (SELECT least(floor(lst_c / 5), (SELECT greatest(ceil(max(lst_c) / 5) - 1, floor(min(lst_c) / 5)) FROM lst_pixels)) * 5.0e0 AS start FROM lst_pixels WHERE lst_c IS NOT NULL)
    SELECT start, count(*) AS n, R4(count(*) * 100.0e0 / (SELECT count(*) FROM v)) AS percent FROM v GROUP BY start""")
def _(d):
    return sel(ST.degree_distribution(d.lst_pixels, "lst_c"), digits=4)


_DIR = "CASE WHEN angle = -1 THEN 'Flat' ELSE ['N','NE','E','SE','S','SW','W','NW'][CAST(floor(((angle + 22.5e0) % 360.0e0) / 45.0e0) AS INT) + 1] END"


@query("aspect_distribution_A26", f"SELECT {_DIR} AS direction, count(*) AS n, R4(count(*) * 100.0e0 / (SELECT count(*) FROM pixels)) AS percent FROM pixels GROUP BY 1")
def _(d):
    counts = ST.count_by(d.pixels.select(RS.aspect_direction("angle").alias("direction")), "direction")
    return sel(ST.share_of_total(counts, "n", "percent"), digits=4)


@query("terrain_summary_A27", """
    SELECT R4(min(elevation)) AS elevation_min, R4(max(elevation)) AS elevation_max, R4(avg(elevation)) AS elevation_mean, R4(quantile_cont(elevation, 0.5)) AS elevation_median,
      R4(stddev_pop(elevation)) AS elevation_std, count(elevation) AS valid_pixels FROM dem""")
def _(d):
    basic = d.dem.agg(F.min("elevation").alias("elevation_min"), F.max("elevation").alias("elevation_max"), F.avg("elevation").alias("elevation_mean"),
                      F.stddev_pop("elevation").alias("elevation_std"), F.count("elevation").alias("valid_pixels"))
    out = ST.attach_quantiles(basic, "_q", d.dem, "elevation", [0.5]).withColumn("elevation_median", F.col("_q")[0]).drop("_q")
    return sel(out, digits=4)


_CAT = "CASE WHEN aqi IS NULL THEN 0 WHEN aqi >= 401 THEN 6 WHEN aqi >= 301 THEN 5 WHEN aqi >= 201 THEN 4 WHEN aqi >= 101 THEN 3 WHEN aqi >= 51 THEN 2 ELSE 1 END"


@query("pollutant_summary_A28", f"""
    WITH s AS (SELECT {COMPOSITE_SQL} AS aqi FROM stations), t AS (SELECT count(aqi) AS t, avg(aqi) AS m, max(aqi) AS x FROM s),
    k AS (SELECT {_CAT} AS code, count(*) AS n FROM s GROUP BY 1)
    SELECT l.label, coalesce(k.n, 0) AS pixels, R4(coalesce(k.n, 0) * 100.0e0 / t) AS percent, R4(m) AS station_mean, R4(x) AS station_max
    FROM (VALUES (1, 'Good'), (2, 'Satisfactory'), (3, 'Moderate'), (4, 'Poor'), (5, 'Very Poor'), (6, 'Severe')) l(code, label) CROSS JOIN t LEFT JOIN k ON k.code = l.code""")
def _(d):
    s = d.stations.select(fn.composite_aqi({p: p for p in K.POLLUTANTS}).alias("aqi")).withColumn("code", fn.aqi_category_code("aqi"))
    table = ST.class_area_table(s, "code", {i + 1: n for i, (n, _) in enumerate(K.AQI_LOWER_BOUNDS)}, 1e6)
    from thermogrid.operators.keyed import attach_row

    out = attach_row(table, "_s", s.agg(F.avg("aqi").alias("m"), F.max("aqi").alias("x")))
    return sel(out.select("label", "pixels", "percent", F.col("_s.m").alias("station_mean"), F.col("_s.x").alias("station_max")), digits=4)


def metrics_sql(table: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return (f"SELECT {keys}count(*) AS n, R6(sqrt(avg(pow(predicted_lst - target_lst, 2)))) AS rmse, R6(avg(abs(predicted_lst - target_lst))) AS mae, "
            f"R6(1 - sum(pow(predicted_lst - target_lst, 2)) / (var_pop(target_lst) * count(*))) AS r2, R6(avg(abs(predicted_lst - target_lst) / greatest(abs(target_lst), 1e-9)) * 100) AS mape FROM {table}"
            + (f" GROUP BY {by} HAVING count(*) >= 2" if by else ""))


@query("regression_metrics_A29", metrics_sql("close_predictions"))
def _(d):
    return sel(M.regression_metrics(d.close_predictions, "target_lst", "predicted_lst"))


@query("seasonal_metrics_A30", metrics_sql("close_predictions", "season"))
def _(d):
    return sel(M.regression_metrics(d.close_predictions, "target_lst", "predicted_lst", ["season"], 2))


@query("residual_summary_A31", """
    WITH r AS (SELECT predicted_lst - target_lst AS e FROM close_predictions) SELECT R4(avg(abs(e))) AS mae, R4(sqrt(avg(e * e))) AS rmse, count(*) AS n,
      count(*) FILTER (e < (SELECT min(e) + (max(e) - min(e)) / 20.0e0 FROM r)) AS first_bin FROM r""")
def _(d):
    r = d.close_predictions.select((F.col("predicted_lst") - F.col("target_lst")).alias("e"))
    m = r.agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count(F.lit(1)).alias("n"))
    first = ST.histogram(r, "e", 20).where("bin = 0").agg(F.max("n").alias("v")).scalar()
    return sel(m.withColumn("first_bin", first), digits=4)


CONF_SQL = """
    WITH q AS (SELECT min(target_lst) AS e0, quantile_cont(target_lst, 1.0 / 3) AS e1, quantile_cont(target_lst, 2.0 / 3) AS e2, max(target_lst) AS e3 FROM close_predictions),
    k AS (SELECT CASE WHEN target_lst <= e1 THEN 'Low' WHEN target_lst <= e2 THEN 'Medium' ELSE 'High' END AS a,
      CASE WHEN predicted_lst < e0 OR predicted_lst > e3 THEN NULL WHEN predicted_lst <= e1 THEN 'Low' WHEN predicted_lst <= e2 THEN 'Medium' ELSE 'High' END AS p FROM close_predictions, q),
    n AS (SELECT a, p, count(*) AS n FROM k WHERE p IS NOT NULL GROUP BY a, p)
"""


@query("tercile_confusion_A32", CONF_SQL + """,
    t AS (SELECT sum(n) AS t, sum(CASE WHEN a = p THEN n ELSE 0 END) AS hit FROM n), ra AS (SELECT a, sum(n) AS r FROM n GROUP BY a), cp AS (SELECT p, sum(n) AS c FROM n GROUP BY p),
    ch AS (SELECT sum(r * 1.0e0 * c) AS s FROM ra JOIN cp ON a = p)
    SELECT l.a AS actual_class, m.p AS predicted_class, coalesce(n.n, 0) AS n, R6(hit * 1.0e0 / (SELECT count(*) FROM k)) AS accuracy,
      R6((hit * 1.0e0 / t - s / (t * 1.0e0 * t)) / (1 - s / (t * 1.0e0 * t))) AS kappa, CAST((SELECT count(*) FROM k) - hit AS BIGINT) AS misclassified
    FROM (VALUES ('Low'), ('Medium'), ('High')) l(a) CROSS JOIN (VALUES ('Low'), ('Medium'), ('High')) m(p) CROSS JOIN t CROSS JOIN ch LEFT JOIN n ON n.a = l.a AND n.p = m.p""")
def _(d):
    return sel(M.confusion_summary(M.tercile_classes(d.close_predictions, "target_lst", "predicted_lst")))


@query("fold_summary_A33", f"WITH m AS ({metrics_sql('close_predictions', 'fold')}) SELECT " + ", ".join(f"R4(avg({c})) AS {c}, R4(stddev_samp({c})) AS {c}_std" for c in ("rmse", "mae", "r2", "mape")) + " FROM m")
def _(d):
    return sel(M.fold_summary(M.regression_metrics(d.close_predictions, "target_lst", "predicted_lst", ["fold"])), digits=4)


@query("catalogue_summary_A38", """
    SELECT count(*) AS scene_count, min(date) AS first_date, max(date) AS latest_date, R1(date_diff('day', min(date), max(date)) / 365.25e0) AS date_range_years,
      count(*) FILTER (month(date) IN (6, 7, 8, 9)) AS monsoon_scenes, min(CASE WHEN month(date) IN (6, 7, 8, 9) THEN CAST(date AS VARCHAR) END) AS first_monsoon FROM scenes""")
def _(d):
    from thermogrid.operators.keyed import attach_row

    wet = TP.dates_per_season(d.scenes).where("season = 'monsoon'").select("n", F.col("first_date").alias("d"))
    return attach_row(TP.catalogue_summary(d.scenes), "_m", wet).select("scene_count", "first_date", "latest_date", "date_range_years", F.coalesce(F.col("_m.n"), F.lit(0)).alias("monsoon_scenes"), F.col("_m.d").alias("first_monsoon"))


@query("cloud_statistics_A39", """
    SELECT scene_key, count(*) AS total_pixels, count(*) FILTER ((qa & 31) <> 0) AS cloud_masked_pixels, count(*) FILTER ((qa & 31) = 0) AS valid_pixels,
      R4(count(*) FILTER ((qa & 31) = 0) * 1.0e0 / count(*)) AS valid_pixel_fraction, R4(count(*) FILTER ((qa & 31) <> 0) * 1.0e0 / count(*)) AS cloud_fraction,
      CASE WHEN R4(count(*) FILTER ((qa & 31) = 0) * 1.0e0 / count(*)) < 0.5 THEN 'low_quality' ELSE 'ok' END AS quality_flag FROM pixels GROUP BY scene_key""")
def _(d):
    return RS.qa_summary(d.pixels, "qa", ["scene_key"])


@query("scene_quality_A40", """
    SELECT scene_id, count(*) AS total_cells, count(lst_c) AS valid_cells, R4(count(lst_c) * 1.0e0 / count(*)) AS valid_fraction,
      CASE WHEN count(lst_c) * 1.0e0 / count(*) < 0.3 THEN 'skipped_low_quality' ELSE 'included' END AS status FROM cell_lst_dates GROUP BY scene_id""")
def _(d):
    return TP.scene_quality(d.cell_lst_dates)


SCENE_STATS = """
    WITH sc AS (SELECT date, avg(lst_c) AS mean_lst, min(lst_c) AS min_lst, max(lst_c) AS max_lst FROM cell_lst_dates GROUP BY date)
"""


def scene_means(d):
    return d.cell_lst_dates.groupBy("date").agg(F.avg("lst_c").alias("mean_lst"), F.min("lst_c").alias("min_lst"), F.max("lst_c").alias("max_lst"))


@query("thermal_analytics_A41", SCENE_STATS + """
    SELECT count(*) AS observation_count, R4(avg(mean_lst)) AS mean_lst, (SELECT date FROM sc ORDER BY max_lst DESC, date LIMIT 1) AS hottest_date, R4(max(max_lst)) AS hottest_max_lst,
      (SELECT date FROM sc ORDER BY min_lst, date LIMIT 1) AS coolest_date, R4(min(min_lst)) AS coolest_min_lst FROM sc""")
def _(d):
    return sel(TP.thermal_analytics(scene_means(d)), digits=4)


@query("seasonal_comparison_A42", SCENE_STATS + """,
    g AS (SELECT CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'pre_monsoon' WHEN month(date) IN (6, 7, 8, 9) THEN 'monsoon' ELSE 'post_monsoon' END AS s, count(*) AS n, avg(mean_lst) AS m FROM sc GROUP BY 1)
    SELECT v.s AS season, coalesce(n, 0) AS n, CASE WHEN n >= 2 THEN 'available' ELSE 'insufficient_data' END AS status, CASE WHEN n >= 2 THEN R4(m) END AS mean_lst
    FROM (VALUES ('winter'), ('pre_monsoon'), ('monsoon'), ('post_monsoon')) v(s) LEFT JOIN g ON g.s = v.s""")
def _(d):
    return sel(TP.seasonal_comparison(scene_means(d)), digits=4)


@query("dataset_report_A43", f"""
    WITH t AS ({TEMPORAL_SQL.format(cols='w.t2m, w.rh2m, o.date')}) SELECT count(*) AS total_rows, count(lst_c) AS valid_lst_rows, count(*) FILTER (t2m IS NOT NULL AND rh2m IS NOT NULL) AS valid_weather_rows,
      count(*) FILTER (t2m IS NOT NULL AND rh2m IS NOT NULL AND lst_c IS NOT NULL) AS complete_rows,
      count(DISTINCT date) AS dates, count(DISTINCT grid_id) AS cells, count(DISTINCT scene_id) AS scenes FROM t""")
def _(d):
    return TP.dataset_report(temporal(d), ["t2m", "rh2m"])


@query("season_report_A43b", f"""
    WITH t AS ({TEMPORAL_SQL.format(cols='o.date')}) SELECT {SEASON_SQL} AS season, count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT grid_id) AS cells FROM t GROUP BY 1""")
def _(d):
    return TP.season_report(temporal(d))


@query("scene_report_A43c", """
    WITH s AS (SELECT scene_id, count(*) AS t, count(lst_c) AS v FROM cell_lst_dates GROUP BY scene_id)
    SELECT CASE WHEN v * 1.0e0 / t < 0.3e0 THEN 'skipped_low_quality' ELSE 'included' END AS status, count(*) AS scenes, CAST(sum(t) AS BIGINT) AS total_cells, CAST(sum(v) AS BIGINT) AS valid_cells FROM s GROUP BY 1""")
def _(d):
    return TP.scene_report(d.cell_lst_dates)


@query("osm_totals_A44", f"""
    SELECT (SELECT count(*) FROM rects) AS buildings, (SELECT R3(sum({SEG_LEN_SQL}) / 1000) FROM segments) AS road_km, R4(sum(CASE WHEN landuse IN ('forest', 'orchard') THEN {RING_AREA_SQL} ELSE 0 END) / 1e6) AS green_km2,
      count(*) FILTER (landuse = 'forest') AS trees FROM rects""")
def _(d):
    from thermogrid.catalog.sources_queries import _line

    polys = lonlat_ring(d).withColumn("a", fn.polygon_area_m2("coords"))
    green = F.col("landuse").isin("forest", "orchard")
    totals = polys.agg(F.count(F.lit(1)).alias("buildings"), round_even(F.sum(F.when(green, F.col("a")).otherwise(0.0)) / 1e6, 4).alias("green_km2"), F.count_if(F.col("landuse") == "forest").alias("trees"))
    km = _line(d).agg(round_even(F.sum(fn.polyline_length_m("coords")) / 1000, 3).alias("k")).scalar()
    return totals.withColumn("road_km", km)


@query("building_audit_A45", """
    SELECT height_source, count(*) AS total, count(*) FILTER (geom_type = 'Polygon') AS valid, count(*) FILTER (geom_type <> 'Polygon') AS invalid, count(*) FILTER (geom_type = 'Polygon' AND height_m > 0) AS height_available FROM rects GROUP BY height_source""")
def _(d):
    ok = F.col("geom_type").isin("Polygon", "MultiPolygon")
    return d.rects.groupBy("height_source").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_if(ok & (F.col("height_m") > 0)).alias("height_available"))


_IMP = """
    WITH c AS (SELECT -0.05e0 * (green_cover - 50.0e0) AS green_cover, -2.0e0 * (coalesce(mean_ndvi, 0.3e0) - 0.3e0) AS mean_ndvi, 0.01e0 * (impervious_ratio - 0.5e0) AS impervious_ratio FROM cells),
    i AS (SELECT 'green_cover' AS feature, avg(abs(green_cover)) AS v FROM c UNION ALL SELECT 'mean_ndvi', avg(abs(mean_ndvi)) FROM c UNION ALL SELECT 'impervious_ratio', avg(abs(impervious_ratio)) FROM c)
"""


def contributions(d):
    return d.cells.select("grid_id", (-0.05 * (F.col("green_cover") - 50.0)).alias("green_cover"), (-2.0 * (F.coalesce("mean_ndvi", F.lit(0.3)) - 0.3)).alias("mean_ndvi"), (0.01 * (F.col("impervious_ratio") - 0.5)).alias("impervious_ratio"))


@query("global_importance_A46", _IMP + "SELECT feature, R6(v) AS mean_abs, R6(v / (SELECT sum(v) FROM i) * 100) AS pct_importance FROM i")
def _(d):
    return sel(C.importance_share(contributions(d), ["grid_id"], ["green_cover", "mean_ndvi", "impervious_ratio"]))


@query("importance_share_A47", "SELECT kind, sum(x1 - x0) AS importance, R6(sum(x1 - x0) / (SELECT sum(x1 - x0) FROM rects) * 100) AS importance_pct FROM rects GROUP BY kind")
def _(d):
    g = d.rects.groupBy("kind").agg(F.sum(F.col("x1") - F.col("x0")).alias("importance"))
    return ST.share_of_total(g, "importance", "importance_pct").select("kind", "importance", *r6("importance_pct"))


@query("satellite_means_A48", "SELECT R6(avg(mean_ndvi)) AS mean_ndvi, R6(avg(max_ndvi)) AS max_ndvi, R6(avg(green_cover)) AS green_cover, R6(avg(land_cover_class)) AS land_cover_class FROM cells")
def _(d):
    return sel(d.cells.agg(*[F.avg(c).alias(c) for c in ("mean_ndvi", "max_ndvi", "green_cover", "land_cover_class")]))


@query("route_statistics_A50", """
    WITH p AS (SELECT iy AS route_id, ix AS step, lon, lat, mean_lst AS lst, lag(lon) OVER (PARTITION BY iy ORDER BY ix) AS plon, lag(lat) OVER (PARTITION BY iy ORDER BY ix) AS plat FROM cells),
    l AS (SELECT *, 2 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) AS leg FROM p)
    SELECT route_id, R0(coalesce(sum(leg), 0.0e0)) AS distance_m, R1(coalesce(sum(leg), 0.0e0) / 1000 / 4.8e0 * 60) AS time_min, R2(avg(lst)) AS avg_lst, R2(max(lst)) AS max_lst, count(*) AS n_cells FROM l GROUP BY route_id""")
def _(d):
    return C.route_statistics(d.cells.select(F.col("iy").alias("route_id"), F.col("ix").alias("step"), "lon", "lat", F.col("mean_lst").alias("lst")))


@query("category_counts_A51", "SELECT kind, count(*) AS n FROM points GROUP BY kind")
def _(d):
    return ST.count_by(d.points, "kind")


@query("display_range_A52", "SELECT R6(quantile_cont(ndvi, 0.02)) AS p2, R6(quantile_cont(ndvi, 0.98)) AS p98 FROM ndvi_pixels")
def _(d):
    q = ST.exact_quantiles(d.ndvi_pixels, ["ndvi"], [0.02, 0.98])
    return q.select(round_even(F.col("q")[0], 6).alias("p2"), round_even(F.col("q")[1], 6).alias("p98"))


@query("id_contiguity_A53", "SELECT min(grid_id) AS first_id, max(grid_id) AS last_id, count(*) AS n, count(*) = max(grid_id) - min(grid_id) + 1 AS contiguous FROM cells")
def _(d):
    g = d.cells.agg(F.min("grid_id").alias("first_id"), F.max("grid_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("contiguous", F.col("n") == F.col("last_id") - F.col("first_id") + 1)


def junction_streets(d):
    """The street grid moved off the cell borders."""
    return street_grid(d).select("segment_id", *[(F.col(c) + 37.0).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("road_junction_density_A5b", STREET_SQL + """,
    j AS (SELECT segment_id, x1 + 37 AS x1, y1 + 37 AS y1, x2 + 37 AS x2, y2 + 37 AS y2 FROM st),""" + nodes_sql("j") + """,
    k AS (SELECT CAST(floor(x / 100) AS BIGINT) AS ix, CAST(floor(y / 100) AS BIGINT) AS iy, count(*) AS n FROM n GROUP BY 1, 2)
    SELECT c.grid_id, coalesce(k.n, 0) AS junctions, R4(coalesce(k.n, 0) / 0.01e0) AS junction_density FROM cells c LEFT JOIN k ON k.ix = c.ix AND k.iy = c.iy""")
def _(d):
    counts = S.count_per_cell(S.network_nodes(junction_streets(d)), "x", "y")
    n = F.coalesce(F.col("n"), F.lit(0))
    return d.cells.select("grid_id", "ix", "iy").join(counts, ["ix", "iy"], "left").select("grid_id", n.alias("junctions"), round_even(n / 0.01, 4).alias("junction_density"))


@query("drop_duplicate_rows_D1", """
    SELECT l_linenumber AS a, l_returnflag AS b, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 300 END AS c, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY 1, 2, 3""")
def _(d):
    rows = d.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("a"), F.col("l_returnflag").alias("b"),
                             F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") % 300).alias("c"))
    return drop_duplicate_rows(rows, "id").select("a", "b", "c", "id")


@query("drop_repeated_dates_D2", "SELECT o_custkey AS site, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, min(o_orderkey) AS k FROM orders GROUP BY 1, 2")
def _(d):
    rows = d.orders.select(F.col("o_custkey").alias("site"), F.trunc("o_orderdate", "MM").alias("date"), F.col("o_orderkey").alias("k"))
    return SR.drop_repeated_dates(rows, ["site"], "date", ["k"])


@query("distinct_tag_values_D3", """
    SELECT tag, count(DISTINCT v) AS n FROM (SELECT 'leisure' AS tag, leisure AS v FROM osm_tags UNION ALL SELECT 'natural', "natural" FROM osm_tags UNION ALL SELECT 'building', building FROM osm_tags) t WHERE v IS NOT NULL GROUP BY tag""")
def _(d):
    long = d.osm_tags.unpivot([], ["leisure", "natural", "building"], "tag", "v").where(F.col("v").isNotNull())
    return long.distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
