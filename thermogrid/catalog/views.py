"""Domain views over the given tables, as one SQL text each, valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# view -> (views or tables it reads, text). k is a unique key counting from 0.
VIEWS: dict[str, tuple[list[str], str]] = {
    "cells": (["orders"], """
        SELECT k AS grid_id, ix, iy,
          85.7e0 + ix * 0.001e0 AS lon, 20.1e0 + iy * 0.0009e0 AS lat,
          ix * 100.0e0 + 50.0e0 AS x, iy * 100.0e0 + 50.0e0 AS y,
          CASE WHEN k % 97 = 0 THEN NULL ELSE (k * 37 % 1000) / 1000.0e0 * 1.2e0 - 0.3e0 END AS mean_ndvi,
          CASE WHEN k % 97 = 0 THEN NULL ELSE (k * 37 % 1000) / 1000.0e0 * 1.2e0 - 0.2e0 END AS max_ndvi,
          (k * 53 % 1001) / 10.0e0 AS green_cover,
          (k * 29 % 1001) / 10.0e0 AS building_coverage_pct,
          (k * 41 % 9000) / 1.0e0 AS building_density,
          (k * 43 % 90) / 1.0e0 AS building_count,
          (k * 61 % 1001) / 1000.0e0 AS impervious_ratio,
          (k % 211) / 1.0e0 AS tree_count,
          (k * 7 % 1001) / 10.0e0 AS tree_density,
          (k * 47 % 1001) / 10.0e0 AS veg_density,
          (k * 59 % 1001) / 10.0e0 AS green_space_pct,
          CASE WHEN k % 79 = 0 THEN NULL ELSE (k * 67 % 20000) / 1.0e0 END AS road_density,
          CASE WHEN k % 89 = 0 THEN NULL ELSE (k * 19 % 3000) / 1.0e0 END AS dist_to_major_road,
          (k * 17 % 5000) / 1.0e0 AS dist_to_park,
          CASE WHEN k % 83 = 0 THEN NULL ELSE (k * 23 % 5000) / 1.0e0 END AS dist_to_water,
          (k * 73 % 300) / 10.0e0 AS mean_slope,
          (k * 5 % 200) / 10.0e0 AS lc_water_pct,
          (k * 23 % 1001) / 10.0e0 AS lc_vegetation_pct,
          CASE WHEN k % 71 = 0 THEN NULL ELSE (k * 31 % 1001) / 10.0e0 END AS lc_builtup_pct,
          (k * 13 % 500) / 10.0e0 AS lc_bare_pct,
          (k * 79 % 1001) / 1000.0e0 AS hvi,
          (k * 83 % 5000) / 1000.0e0 AS green_to_built,
          (k * 89 % 1001) / 1000.0e0 AS veg_cooling,
          (k * 97 % 1001) / 1000.0e0 AS cooling_distance,
          CASE WHEN k % 101 = 0 THEN NULL ELSE (k * 97 % 4500) / 10.0e0 END AS mean_aqi,
          (k * 19 % 2600) / 10.0e0 AS mean_pm25,
          1 + k % 4 AS land_cover_class,
          1 + k * 7 % 5 AS veg_density_class,
          30.0e0 + (k * 71 % 2200) / 100.0e0 AS mean_lst
        FROM (SELECT o_orderkey AS k, o_orderkey % 120 AS ix, CAST(floor(o_orderkey / 120.0e0) AS BIGINT) AS iy FROM orders) o"""),
    "pixels": (["lineitem"], """
        SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS col_id, l_partkey % 120 AS ix, l_suppkey % 120 AS iy,
          l_suppkey AS scene_key,
          CASE WHEN l_partkey % 53 = 0 THEN 0 ELSE 38000 + l_partkey * 97 % 15000 END AS dn,
          (l_suppkey * 7 + l_partkey) % 64 AS qa,
          CASE WHEN l_partkey % 31 = 0 THEN -1.0e0 ELSE (l_partkey * 13 % 3600) / 10.0e0 END AS angle,
          CASE WHEN l_partkey % 59 = 0 THEN 0 ELSE 200 + l_partkey * 11 % 6000 END AS red_dn,
          CASE WHEN l_partkey % 59 = 0 THEN 0 ELSE 300 + l_suppkey * 37 % 6000 END AS nir_dn,
          CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_partkey % 5 END AS class_code,
          (l_partkey % 120) * 100.0e0 + (l_orderkey % 100) * 1.0e0 AS x, (l_suppkey % 120) * 100.0e0 + l_linenumber * 7.0e0 AS y
        FROM lineitem"""),
    "lst_pixels": (["pixels"], """
        SELECT row_id, col_id, ix, iy, scene_key, qa,
          CASE WHEN dn = 0 OR qa % 32 <> 0 THEN NULL ELSE dn * 0.00341802e0 + 149.0e0 - 273.15e0 END AS lst_c
        FROM pixels"""),
    "ndvi_pixels": (["pixels"], """
        SELECT row_id, col_id, ix, iy, red_dn, nir_dn,
          CASE WHEN nir_dn + red_dn > 0 THEN (nir_dn * 1.0e0 - red_dn) / (nir_dn + red_dn) END AS ndvi
        FROM pixels"""),
    "dem": (["orders"], """
        SELECT CAST(floor(o_orderkey / 120.0e0) AS BIGINT) AS "row", o_orderkey % 120 AS col,
          CASE WHEN o_orderkey % 37 = 0 THEN NULL
               ELSE 20.0e0 + (o_orderkey * 13 % 97) / 3.0e0 + (o_orderkey % 120) / 7.0e0 END AS elevation,
          20.0e0 + (o_orderkey * 13 % 97) / 3.0e0 + (o_orderkey % 120) / 7.0e0 AS ground
        FROM orders"""),
    "weather_daily": (["events"], """
        SELECT site, CASE WHEN site = 'click' THEN min(day) ELSE CAST(DATE '2024-01-01' + day_no * 3 AS DATE) END AS date,
          avg(value) * 0.2003e0 + 24.0e0 AS t2m, least(max(value) * 0.6007e0, 100.0e0) AS rh2m,
          CASE WHEN count(*) % 7 = 0 THEN NULL ELSE min(value) + 1.0e0 END AS ws2m, count(*) AS n
        FROM (SELECT event_type AS site, CAST(ts AS DATE) AS day, value,
            CAST((extract(year FROM ts) - 2024) * 366 + extract(doy FROM ts) AS INT) - 1 AS day_no FROM events) e
        GROUP BY site, day_no"""),
    "weather_long": (["orders"], """
        SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 10007.0e0 AS t2m,
          least(max(o_totalprice) / 5507.0e0, 100.0e0) AS rh2m,
          CASE WHEN count(*) % 7 = 0 THEN NULL ELSE min(o_totalprice) / 50021.0e0 END AS ws2m
        FROM orders GROUP BY CAST(o_orderdate AS DATE)"""),
    "stations": (["supplier"], """
        SELECT k AS station_id, 20.1e0 + (k * 13 % 300) / 1000.0e0 AS lat, 85.7e0 + (k * 29 % 250) / 1000.0e0 AS lon,
          (k * 7919 % 12000) * 1.0e0 AS x, (k * 104729 % 12600) * 1.0e0 AS y,
          (k * 19 % 260) * 1.0e0 - 5.0e0 AS pm25, (k * 31 % 440) * 1.0e0 - 3.0e0 AS pm10, (k * 17 % 420) * 1.0e0 AS no2,
          (k * 23 % 1700) * 1.0e0 AS so2, (k * 43 % 2100) * 1.0e0 AS co, (k * 37 % 800) * 1.0e0 AS o3
        FROM (SELECT s_suppkey AS k FROM supplier) s"""),
    "points": (["customer"], """
        SELECT c_custkey AS point_id, c_mktsegment AS kind, (c_custkey * 7919 % 12000) * 1.0e0 AS x,
          (c_custkey * 104729 % 12600) * 1.0e0 AS y,
          85.7e0 + (c_custkey * 7919 % 12000) / 100000.0e0 AS lon, 20.1e0 + (c_custkey * 104729 % 12600) / 111000.0e0 AS lat
        FROM customer"""),
    "rects": (["part"], """
        SELECT p_partkey AS rect_id, p_brand AS kind,
          (p_partkey * 7919 % 11900) * 1.0e0 AS x0, (p_partkey * 104729 % 12500) * 1.0e0 AS y0,
          (p_partkey * 7919 % 11900) * 1.0e0 + p_size * 4.0e0 AS x1, (p_partkey * 104729 % 12500) * 1.0e0 + p_size * 3.0e0 AS y1,
          CASE p_partkey % 9 WHEN 0 THEN 'residential' WHEN 1 THEN 'retail' WHEN 2 THEN 'quarry' WHEN 3 THEN 'religious'
            WHEN 4 THEN 'orchard' WHEN 5 THEN 'forest' WHEN 6 THEN 'railway' WHEN 7 THEN ' grass ' ELSE 'plaza' END AS landuse,
          CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 0.5e0 END AS height_m,
          CASE WHEN p_partkey % 5 = 0 THEN 'none' WHEN p_partkey % 3 = 0 THEN 'levels' ELSE 'osm' END AS height_source,
          CASE WHEN p_partkey % 41 = 0 THEN 'Point' ELSE 'Polygon' END AS geom_type
        FROM part"""),
    "segments": (["part"], """
        SELECT p_partkey AS segment_id, x1, y1,
          CASE p_partkey % 3 WHEN 0 THEN x1 WHEN 1 THEN x1 + p_size * 9.0e0 ELSE x1 + p_size * 9.0e0 END AS x2,
          CASE p_partkey % 3 WHEN 1 THEN y1 ELSE y1 + p_size * 5.0e0 END AS y2,
          CASE p_partkey % 18 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'footway'
            WHEN 4 THEN ' secondary ' WHEN 5 THEN 'path' WHEN 6 THEN 'residential' WHEN 7 THEN 'service' WHEN 8 THEN 'cycleway'
            WHEN 9 THEN 'tertiary_link' WHEN 10 THEN 'living_street' WHEN 11 THEN 'steps' WHEN 12 THEN 'raceway'
            WHEN 13 THEN 'track' WHEN 14 THEN 'unclassified' WHEN 15 THEN 'construction' WHEN 16 THEN NULL ELSE 'tertiary' END AS highway
        FROM (SELECT p_partkey, p_size, (p_partkey * 7919 % 11900) * 1.0e0 + 0.37e0 AS x1,
                     (p_partkey * 104729 % 12500) * 1.0e0 + 0.61e0 AS y1 FROM part) p"""),
    "scenes": (["supplier"], """
        SELECT CAST(k AS BIGINT) AS scene_key, concat('LC09_', CAST(k AS VARCHAR(10))) AS scene_id,
          CAST(DATE '2024-01-01' + CAST(k * 16 % 3650 AS INT) AS DATE) AS date,
          (k * 7 % 40) * 1.0e0 AS cloud_cover,
          85.6e0 + (k % 4) * 0.06e0 AS xmin, 20.0e0 + (k % 3) * 0.06e0 AS ymin, 86.0e0 + (k % 5) * 0.01e0 AS xmax, 20.6e0 AS ymax,
          CASE WHEN k % 6 = 0 THEN NULL ELSE 0.0034e0 + k % 25 * 0.00001e0 END AS scale_mul,
          CASE WHEN k % 6 = 0 THEN NULL ELSE 149.0e0 + k % 25 * 0.01e0 END AS scale_add,
          32.0e0 + (k * 11 % 17) * 0.5e0 AS mean_lst, 25.0e0 + (k * 7 % 11) * 0.4e0 AS min_lst, 41.0e0 + (k * 5 % 13) * 0.6e0 AS max_lst
        FROM (SELECT s_suppkey AS k FROM supplier) n"""),
    "cell_lst_dates": (["lineitem", "cells", "scenes"], """
        SELECT g.grid_id, g.scene_key, s.scene_id, s.date, s.cloud_cover,
          CASE WHEN (g.grid_id + g.scene_key) % 41 = 0 OR (g.scene_key % 5 = 0 AND g.grid_id % 10 < 8) THEN NULL
               ELSE c.mean_lst + (g.grid_id * g.scene_key % 500) / 100.0e0 - 2.5e0 + g.n * 0.25e0 END AS lst_c
        FROM (SELECT l_orderkey AS grid_id, l_suppkey AS scene_key, count(*) AS n
              FROM lineitem GROUP BY l_orderkey, l_suppkey) g
        JOIN scenes s ON s.scene_key = g.scene_key JOIN cells c ON c.grid_id = g.grid_id"""),
    "cell_two_dates": (["cells"], """
        SELECT grid_id, side, CASE WHEN (grid_id + side) % 41 = 0 THEN NULL
          ELSE mean_lst + side * ((grid_id * 3 % 500) / 100.0e0 - 2.5e0) END AS lst_c
        FROM (SELECT grid_id, mean_lst, 0 AS side FROM cells
              UNION ALL SELECT grid_id + 70 AS grid_id, mean_lst, 1 AS side FROM cells) b"""),
    "predictions": (["cells"], """
        SELECT grid_id, mean_lst AS target_lst,
          35.0e0 - 0.05e0 * green_cover - 2.0e0 * coalesce(mean_ndvi, 0.0e0) + 0.01e0 * impervious_ratio AS predicted_lst,
          (grid_id * 31 % 5) AS fold, CASE grid_id % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'pre_monsoon' WHEN 2 THEN 'monsoon' ELSE 'post_monsoon' END AS season
        FROM cells"""),
    "close_predictions": (["cells"], """
        SELECT grid_id, mean_lst AS target_lst, mean_lst + ((grid_id * 17 % 900) / 100.0e0 - 4.5e0) * 0.7e0 AS predicted_lst,
          (grid_id * 31 % 5) AS fold, CASE grid_id % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'pre_monsoon' WHEN 2 THEN 'monsoon' ELSE 'post_monsoon' END AS season
        FROM cells"""),
    "observations": (["events"], """
        SELECT event_id, event_type AS source, ts AS observed_at, value, props, user_id FROM events"""),
    "osm_tags": (["part"], """
        SELECT p_partkey AS feature_id,
          CASE p_partkey % 4 WHEN 0 THEN 'park' WHEN 1 THEN ' Garden ' WHEN 2 THEN '' ELSE NULL END AS leisure,
          CASE p_partkey % 5 WHEN 0 THEN 'tree' WHEN 1 THEN 'water' WHEN 2 THEN 'Tree Row (old)' ELSE NULL END AS "natural",
          CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'school' ELSE NULL END AS building,
          p_name AS name
        FROM part"""),
}


def view_sql(names: list[str]) -> str:
    """The WITH clause that makes these views, and what they read, available to a DuckDB query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for parent in VIEWS[name][0]:
                add(parent)
            ordered.append(name)

    for n in names:
        add(n)
    if not ordered:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n"


class Data:
    """Lazy access to the given tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            parents, text = VIEWS[name]
            for parent in parents:
                text = _replace_word(text, parent, "{" + parent + "}")
            text = text.replace('"row"', "`row`").replace('"natural"', "`natural`")
            return self.spark.sql(text, **{p: getattr(self, p) for p in parents})
        raise AttributeError(name)


def _replace_word(text: str, word: str, new: str) -> str:
    import re

    return re.sub(rf"(?<=FROM )\b{word}\b|(?<=JOIN )\b{word}\b", new, text)
