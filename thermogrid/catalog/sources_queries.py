"""Scans, parsers and sinks. Files are first derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid.catalog.registry import query
from thermogrid.functions import polyline_length_m, round_even
from thermogrid.operators.keyed import insert_ignore, not_yet_stored
from thermogrid.operators.raster import merge_tiles
from thermogrid.operators.stats import count_by, feature_statistics, missing_report, scaled_columns
from thermogrid.session import scratch_path
from thermogrid.sources import parsers as P, readers as R, sinks as S

CSV_SCHEMA = "grid_id bigint, mean_lst double, mean_ndvi double, green_cover double, season string, tree_count double"


def _r6(*names):
    return [round_even(n, 6).alias(n) for n in names]


@query("csv_scan_columns_S1", "SELECT CAST(grid_id AS VARCHAR) AS grid_id, R6(mean_lst) AS mean_lst, R6(mean_ndvi) AS mean_ndvi FROM cells")
def _(d):
    path = scratch_path(d.spark, "csv")
    S.write_csv(d.cells.select("grid_id", "mean_lst", "mean_ndvi", "green_cover", F.lit("winter").alias("season"), "tree_count"), path)
    df = R.read_csv_columns(d.spark, path, CSV_SCHEMA, ["grid_id", "mean_lst", "mean_ndvi"], "grid_id")
    return df.select("grid_id", *_r6("mean_lst", "mean_ndvi"))


_RING = lambda: S.square_ring(F.col("x") - 50, F.col("y") - 50, F.col("x") + 50, F.col("y") + 50)


@query("geojson_scan_S2", """
    SELECT grid_id, R6(mean_lst) AS mean_lst, 'Polygon' AS geom_type, 5 AS vertices, R6(x - 50) AS left_x, R6(y - 50) AS bottom_y FROM cells""")
def _(d):
    from thermogrid.functions import flatten_positions

    path = scratch_path(d.spark, "geojson")
    S.write_geojson_lines(S.geojson_features(d.cells, ["grid_id", "mean_lst"], _RING()), path)
    df = R.read_geojson(d.spark, path, "grid_id: bigint, mean_lst: double")
    p = flatten_positions("geom_type", "coordinates")
    df = df.withColumn("p", p)
    return df.select("grid_id", *_r6("mean_lst"), "geom_type", F.size("p").alias("vertices"),
                     round_even(F.array_min(F.transform("p", lambda c: c["x"])), 6).alias("left_x"),
                     round_even(F.array_min(F.transform("p", lambda c: c["y"])), 6).alias("bottom_y"))


@query("geojson_document_S2b", """
    SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) AS nation, 'Point' AS geom_type, n_nationkey * 1.0e0 AS x FROM nation""")
def _(d):
    """One document per region, over several lines."""
    from thermogrid.functions import flatten_positions

    path = scratch_path(d.spark, "geojson-documents")
    nation = d.spark.read.parquet(f"{d.folder}/nation.parquet")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)).alias("coordinates"))
    properties = F.struct(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("nation"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), point.alias("geometry"))
    documents = nation.groupBy("n_regionkey").agg(F.collect_list(feature).alias("features"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"), {"pretty": "true"})
    documents.select("n_regionkey", text.alias("value")).write.partitionBy("n_regionkey").text(path)
    df = R.read_geojson_document(d.spark, f"{path}/*", "region: bigint, nation: bigint").withColumn("p", flatten_positions("geom_type", "coordinates"))
    return df.select("region", "nation", "geom_type", F.col("p")[0]["x"].alias("x"))


@query("merge_layer_candidates_S3", """
    SELECT CAST(point_id AS BIGINT) AS feature_id, kind, CAST(NULL AS VARCHAR) AS landuse, R6(x) AS x FROM points
    UNION ALL SELECT CAST(rect_id AS BIGINT), kind, landuse, R6(x0) FROM rects""")
def _(d):
    base = scratch_path(d.spark, "layer")
    d.points.select(F.col("point_id").alias("feature_id"), "kind", "x").write.parquet(f"{base}/all")
    d.rects.select(F.col("rect_id").alias("feature_id"), "kind", "landuse", F.col("x0").alias("x")).write.parquet(f"{base}/extra")
    layer = R.read_layer(d.spark, [f"{base}/all", f"{base}/absent", f"{base}/extra", f"{base}/all"])
    return layer.select("feature_id", "kind", "landuse", *_r6("x"))


@query("weather_parameter_map_S4", """
    SELECT date, R6(t2m) AS t2m, R6(CASE WHEN ws2m IS NULL THEN NULL ELSE ws2m END) AS ws2m, R6(rh2m * 10.0e0) AS ps FROM weather_long""")
def _(d):
    # One document per month: {"properties": {"parameter": {"T2M": {"20240101": ...}, ...}}}
    day = F.date_format("date", "yyyyMMdd")
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct(day, F.coalesce(F.col(c), F.lit(-999.0)))))
    params = F.create_map(F.lit("T2M"), entries("t2m"), F.lit("WS2M"), entries("ws2m"), F.lit("PS"), entries("rh2m"))
    docs = d.weather_long.groupBy(F.trunc("date", "MM").alias("m")).agg(
        F.to_json(F.struct(F.struct(params.alias("parameter")).alias("properties"))).alias("body"))
    df = P.daily_parameters(docs, "body", ["t2m", "ws2m", "ps"])
    return df.select("date", *_r6("t2m", "ws2m", "ps"))


@query("weather_daily_arrays_S5", """
    SELECT date, R6(t2m) AS temperature_max, R6(rh2m) AS humidity, R6(ws2m) AS wind_speed,
      round_even(rh2m * 1e6 / 86400.0e0 * 100.0e0, 0) / 100.0e0 AS solar_radiation FROM weather_long""")
def _(d):
    listed = F.array_sort(F.collect_list(F.struct("date", "t2m", "rh2m", "ws2m")))
    docs = d.weather_long.groupBy(F.trunc("date", "MM").alias("m")).agg(listed.alias("v"))
    pick = lambda c, n: F.transform("v", lambda r: r[c]).alias(n)
    body = F.to_json(F.struct(F.struct(
        F.transform("v", lambda r: r["date"].cast("string")).alias("time"), pick("t2m", "temperature_2m_max"),
        pick("rh2m", "relative_humidity_2m_mean"), pick("ws2m", "wind_speed_10m_max"), pick("rh2m", "shortwave_radiation_sum"),
    ).alias("daily")), {"ignoreNullFields": "false"})
    df = P.daily_arrays(docs.select(body.alias("body")), "body")
    return df.select("date", *_r6("temperature_max", "humidity", "wind_speed"), "solar_radiation")


@query("measurements_wide_S6", """
    SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(event_id AS BIGINT) AS event_id,
      CASE WHEN source = 'click' THEN R6(value) END AS pm25, CASE WHEN source = 'view' THEN R6(value) END AS no2
    FROM observations WHERE source IN ('click', 'view')""")
def _(d):
    # The event id travels as latitude so that each row can be told apart afterwards.
    name = F.when(F.col("source") == "click", F.lit("PM2.5")).when(F.col("source") == "view", F.lit("no2")).otherwise(F.lit("humidity"))
    one = F.struct(
        F.struct(name.alias("name")).alias("parameter"), F.col("value"), F.col("user_id").alias("locationId"),
        F.struct(F.col("event_id").cast("double").alias("latitude"), F.lit(85.8).alias("longitude")).alias("coordinates"),
        F.struct(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetime"))
    docs = d.observations.select(F.to_json(F.struct(F.array(one).alias("results"))).alias("body"))
    df = P.measurements_wide(docs, "body")
    return df.select("station_id", F.col("lat").cast("bigint").alias("event_id"), *_r6("pm25", "no2"))


@query("column_density_points_S7", """
    SELECT row_id, col_id, R6((dn * 1e-9 - 0.00004e0) / 1000.0e0 * 46.0055e0 * 1e6) AS no2
    FROM pixels WHERE qa >= 50 AND dn * 1e-9 - 0.00004e0 > 0 AND 85.6e0 + ix * 0.005e0 BETWEEN 85.7e0 AND 86.0e0
      AND 19.9e0 + iy * 0.005e0 BETWEEN 20.0e0 AND 20.5e0""")
def _(d):
    px = d.pixels.select("row_id", "col_id", "qa", (F.col("dn") * 1e-9 - 0.00004).alias("density"),
                         (85.6 + F.col("ix") * 0.005).alias("lon"), (19.9 + F.col("iy") * 0.005).alias("lat"))
    return P.column_density_points(px, "no2", "density", "qa").select("row_id", "col_id", *_r6("no2"))


@query("provider_chain_S8", """
    WITH u AS (
      SELECT 0 AS p, station_id, R4(lat) AS lat, R4(lon) AS lon, R6(pm25) AS pm25, 'satellite' AS source FROM stations
      UNION ALL SELECT 1, point_id, R4(lat), R4(lon), R6(x), 'network' FROM points)
    SELECT station_id, lat, lon, pm25, source FROM (
      SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY p, station_id) AS rn FROM u) t WHERE rn = 1""")
def _(d):
    a = d.stations.select("station_id", "lat", "lon", "pm25", F.lit("satellite").alias("source"))
    b = d.points.select(F.col("point_id").alias("station_id"), "lat", "lon", F.col("x").alias("pm25"), F.lit("network").alias("source"))
    df = P.merge_providers([a, b])
    return df.select("station_id", round_even("lat", 4).alias("lat"), round_even("lon", 4).alias("lon"), *_r6("pm25"), "source")


@query("scene_catalogue_S9", """
    SELECT date, scene_id, cloud_cover, 'unknown' AS season, R6(mean_lst) AS mean_lst, R6(min_lst) AS min_lst, R6(max_lst) AS max_lst FROM scenes""")
def _(d):
    stats = F.struct(F.col("mean_lst").alias("mean_lst_c"), F.col("min_lst").alias("min_lst_c"), F.col("max_lst").alias("max_lst_c"))
    item = F.struct(F.col("date").cast("string").alias("date"), "scene_id", F.col("cloud_cover").alias("cloud_cover_pct"), stats.alias("lst_stats"))
    docs = d.scenes.groupBy(F.year("date").alias("y")).agg(F.to_json(F.struct(F.collect_list(item).alias("observations"))).alias("body"))
    return P.scene_catalogue(docs, "body").select("date", "scene_id", "cloud_cover", "season", *_r6("mean_lst", "min_lst", "max_lst"))


LAYER_LABELS = {("leisure", "park"): "parks", ("natural", "tree"): "trees", ("building", "school"): "buildings_school"}
_TAG_SQL = """
    WITH long AS (
      SELECT feature_id, name, 'leisure' AS tag, leisure AS v FROM osm_tags UNION ALL
      SELECT feature_id, name, 'natural', "natural" FROM osm_tags UNION ALL
      SELECT feature_id, name, 'building', building FROM osm_tags),
    named AS (
      SELECT feature_id, name, tag, lower(trim(v)) AS v FROM long WHERE trim(v) <> ''),
    layers AS (
      SELECT feature_id, name, CASE WHEN tag = 'leisure' AND v = 'park' THEN 'parks' WHEN tag = 'natural' AND v = 'tree' THEN 'trees'
          WHEN tag = 'building' AND v = 'school' THEN 'buildings_school'
          ELSE replace(replace(replace(tag || '_' || v, ' ', '_'), '(', ''), ')', '') END AS layer FROM named
      UNION ALL SELECT feature_id, name, 'all_' || tag FROM named)
"""


@query("tag_layers_S10", _TAG_SQL + "SELECT DISTINCT feature_id, name, layer FROM layers")
def _(d):
    path = scratch_path(d.spark, "layers")
    S.write_layers(P.tag_layers(d.osm_tags, ["leisure", "natural", "building"], LAYER_LABELS), path)
    return d.spark.read.parquet(path).select("feature_id", "name", "layer")


@query("layer_summary_S11", _TAG_SQL + "SELECT layer, count(*) AS n FROM (SELECT DISTINCT * FROM layers) t GROUP BY layer")
def _(d):
    return count_by(P.tag_layers(d.osm_tags, ["leisure", "natural", "building"], LAYER_LABELS), "layer")


@query("csv_sinks_S12", """
    SELECT grid_id, R6((green_cover - (SELECT avg(green_cover) FROM cells)) / (SELECT stddev_pop(green_cover) FROM cells)) AS green_cover,
      R6((mean_lst - (SELECT avg(mean_lst) FROM cells)) / (SELECT stddev_pop(mean_lst) FROM cells)) AS mean_lst FROM cells""")
def _(d):
    raw = d.cells.select("grid_id", "green_cover", "mean_lst")
    base = scratch_path(d.spark, "dataset")
    S.write_csv(raw, f"{base}/raw")
    S.write_csv(scaled_columns(raw, ["green_cover", "mean_lst"]), f"{base}/normalised")
    df = d.spark.read.schema("grid_id bigint, green_cover double, mean_lst double").option("header", True).csv(f"{base}/normalised")
    return df.select("grid_id", *_r6("green_cover", "mean_lst"))


@query("geojson_sink_S13", """
    SELECT c.grid_id, R6(p.predicted_lst) AS predicted_lst, R6(p.predicted_lst - p.target_lst) AS lst_residual
    FROM cells c JOIN predictions p ON c.grid_id = p.grid_id""")
def _(d):
    from thermogrid.plans.city import attach_predictions

    path = scratch_path(d.spark, "predicted")
    joined = attach_predictions(d.cells, d.predictions.select("grid_id", "predicted_lst"), "mean_lst")
    S.write_geojson_lines(S.geojson_features(joined, ["grid_id", "predicted_lst", "lst_residual"], _RING()), path)
    df = R.read_geojson(d.spark, path, "grid_id: bigint, predicted_lst: double, lst_residual: double")
    return df.select("grid_id", *_r6("predicted_lst", "lst_residual"))


@query("json_reports_S14", """
    SELECT 'mean_ndvi' AS "column", count(mean_ndvi) AS n, R6(avg(mean_ndvi)) AS mean, R6(quantile_cont(mean_ndvi, 0.5)) AS median,
      count(*) - count(mean_ndvi) AS missing_count FROM cells UNION ALL
    SELECT 'mean_aqi', count(mean_aqi), R6(avg(mean_aqi)), R6(quantile_cont(mean_aqi, 0.5)), count(*) - count(mean_aqi) FROM cells""")
def _(d):
    base = scratch_path(d.spark, "reports")
    cols = ["mean_ndvi", "mean_aqi"]
    S.write_report(feature_statistics(d.cells, cols), f"{base}/statistics")
    S.write_report(missing_report(d.cells, cols), f"{base}/missing")
    stats = d.spark.read.schema("column string, count bigint, mean double, median double").json(f"{base}/statistics")
    missing = d.spark.read.schema("column string, missing_count bigint").json(f"{base}/missing")
    return stats.join(missing, "column").select("column", F.col("count").alias("n"), *_r6("mean", "median"), "missing_count")


@query("insert_ignore_S15", """
    WITH incoming AS (SELECT l_orderkey AS grid_id, min(l_partkey) AS v FROM lineitem GROUP BY l_orderkey),
    existing AS (SELECT DISTINCT o_custkey AS grid_id FROM orders)
    SELECT i.grid_id, i.v FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.grid_id = i.grid_id)""")
def _(d):
    existing = d.orders.select(F.col("o_custkey").alias("grid_id")).distinct()
    incoming = d.lineitem.select(F.col("l_orderkey").alias("grid_id"), F.col("l_partkey").alias("v"))
    return insert_ignore(existing, incoming, "grid_id")


@query("bounding_box_S16", """
    SELECT grid_id, R6(mean_lst) AS mean_lst FROM cells
    WHERE lon BETWEEN 85.72e0 - 0.0005e0 AND 85.76e0 + 0.0005e0 AND lat BETWEEN 20.12e0 - 0.00045e0 AND 20.16e0 + 0.00045e0
    ORDER BY grid_id""")
def _(d):
    return R.bounding_box(d.cells, 85.72, 20.12, 85.76, 20.16, (0.0005, 0.00045)).select("grid_id", *_r6("mean_lst"))


@query("merge_tiles_S17", """
    WITH t AS (
      SELECT 0 AS tile, "row", col, elevation AS value FROM dem UNION ALL
      SELECT 1, "row" + 5, col, elevation + 1000 FROM dem)
    SELECT "row", col, R6(value) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY tile) AS rn FROM t WHERE value IS NOT NULL) q WHERE rn = 1""")
def _(d):
    a = d.dem.select("row", "col", F.col("elevation").alias("value"))
    b = d.dem.select((F.col("row") + 5).alias("row"), "col", (F.col("elevation") + 1000).alias("value"))
    return merge_tiles([a, b]).select("row", "col", *_r6("value"))


@query("incremental_fetch_S18", """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
    WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)""")
def _(d):
    wanted = d.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    return not_yet_stored(wanted, d.lineitem.select(F.to_date("l_shipdate").alias("date")).distinct(), "date")


def _line(d):
    s = d.segments
    lon, lat = (lambda c: 85.7 + F.col(c) / 104000.0), (lambda c: 20.1 + F.col(c) / 111000.0)
    pt = lambda a, b: F.struct(lon(a).alias("x"), lat(b).alias("y"))
    return s.select("segment_id", F.array(pt("x1", "y1"), pt("x2", "y1"), pt("x2", "y2")).alias("coords"))


_LON, _LAT = "85.7e0 + {} / 104000.0e0", "20.1e0 + {} / 111000.0e0"


def _leg(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
            f"* pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))")


_ROWS_SQL = f"""
    WITH l AS (SELECT segment_id, {_LON.format('x1')} AS ax, {_LAT.format('y1')} AS ay, {_LON.format('x2')} AS bx, {_LAT.format('y2')} AS by_ FROM segments),
    t AS (SELECT *, {_leg('ay', 'ax', 'ay', 'bx')} + {_leg('ay', 'bx', 'by_', 'bx')} AS metres FROM l),
    k AS (SELECT *, CAST(greatest(2, floor(metres / 40.0e0)) AS BIGINT) AS n FROM t),
    s AS (SELECT k.*, i.i, i.i * 1.0e0 / greatest(1, n - 1) * 2 AS at_ FROM k, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i) i)
"""


@query("tree_layer_S19", _ROWS_SQL + """
    SELECT R6(lon) AS lon, R6(lat) AS lat, 'tree' AS kind FROM points UNION ALL
    SELECT CASE WHEN at_ < 1 THEN R6(ax + (bx - ax) * at_) ELSE R6(bx + (bx - bx) * (at_ - 1)) END, CASE WHEN at_ < 1 THEN R6(ay) ELSE R6(ay + (by_ - ay) * (at_ - 1)) END, 'tree_row' FROM s UNION ALL
    SELECT R6((85.7e0 + x0 / 104000.0e0 + 85.7e0 + x1 / 104000.0e0) / 2), R6((20.1e0 + y0 / 111000.0e0 + 20.1e0 + y1 / 111000.0e0) / 2),
      CASE WHEN landuse = 'forest' THEN 'natural_wood' ELSE 'natural_scrub' END FROM rects WHERE landuse IN ('forest', 'orchard')""")
def _(d):
    areas = d.rects.select(
        F.when(F.col("landuse") == "forest", F.lit("Wood")).when(F.col("landuse") == "orchard", F.lit("scrub")).otherwise(F.col("landuse")).alias("natural"),
        F.array(*[F.struct((85.7 + F.col(a) / 104000.0).alias("x"), (20.1 + F.col(b) / 111000.0).alias("y"))
                  for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]).alias("coords"))
    trees = P.tree_points(d.points.select("lon", "lat"), _line(d), areas)
    return trees.select(round_even("lon", 6).alias("lon"), round_even("lat", 6).alias("lat"), "kind")


@query("tree_row_points_X4", _ROWS_SQL + "SELECT segment_id, CAST(i AS BIGINT) AS k, R3(metres) AS length_m FROM s")
def _(d):
    """How many points each tree row grows into, and its length."""
    rows = _line(d).withColumn("length_m", polyline_length_m("coords"))
    n = F.greatest(F.lit(2), F.floor(F.col("length_m") / 40.0).cast("int"))
    return rows.select("segment_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), round_even("length_m", 3).alias("length_m"))
