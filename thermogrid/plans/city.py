"""City questions over cells, predictions and scenario results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from thermogrid import constants as K, functions as fn
from thermogrid.functions import haversine_m, round_even
from thermogrid.operators.keyed import attach_row, top_n
from thermogrid.operators.spatial import nearest_features
from thermogrid.operators.stats import attach_quantiles, unpivot_columns


def attach_predictions(cells: DataFrame, predictions: DataFrame, target: str) -> DataFrame:
    """Predicted value and residual per cell; cells without a prediction keep nulls."""
    joined = cells.join(predictions, "grid_id", "left")
    return joined.withColumn("lst_residual", F.col("predicted_lst") - F.col(target))


def baseline_with_fallback(cells: DataFrame, scenario_baseline: DataFrame, test_predictions: DataFrame) -> DataFrame:
    """Scenario baseline per cell, else the test-set prediction, else null."""
    a = scenario_baseline.select("grid_id", F.col("baseline_lst").alias("_a"))
    b = test_predictions.select("grid_id", F.col("predicted_lst").alias("_b"))
    joined = cells.join(a, "grid_id", "left").join(b, "grid_id", "left")
    return joined.withColumn("predicted_lst", F.coalesce("_a", "_b")).drop("_a", "_b")


def hotspots(cells: DataFrame, predicted: str = "predicted_lst", limit: int = 50) -> DataFrame:
    """Hottest cells by the value rounded to 2 places, in grid order on ties."""
    rounded = cells.where(F.col(predicted).isNotNull()).withColumn("heat", fn.heat_label(predicted)).withColumn(predicted, round_even(predicted, 2))
    return rounded.orderBy(F.desc(predicted), "grid_id").limit(limit)


def enrich(hot: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hot cells with their features; `hot` is a top-k result, so it is the small side."""
    return features.select("grid_id", *columns).join(F.broadcast(hot), "grid_id", "right")


def nearest_cells(points: DataFrame, cells: DataFrame, max_km: float = 3.0) -> DataFrame:
    """Nearest cell per point (point_id, lon, lat) by great-circle distance, none beyond max_km.

    The search prunes by bounds that hold on the sphere at any latitude.
    """
    queries = points.select("point_id", F.col("lon").alias("qx"), F.col("lat").alias("qy"))
    x, y = F.col("lon"), F.col("lat")
    features = cells.select("grid_id", x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2"))
    found = nearest_features(queries, features, 1, "point_id", "grid_id", sphere=True)
    return found.where(F.col("distance") <= max_km * 1000.0).select("point_id", "grid_id", F.col("distance").alias("distance_m"))


def point_profiles(points: DataFrame, cells: DataFrame, predictions: DataFrame) -> DataFrame:
    """Everything known at a point: nearest cell, features, prediction, classes and risks."""
    near = nearest_cells(points, cells)
    joined = points.join(near, "point_id", "left").join(cells.drop("lon", "lat", "x", "y"), "grid_id", "left").join(predictions, "grid_id", "left")
    heat, aqi = fn.heat_label("mean_lst"), fn.aqi_category("mean_aqi")
    return joined.withColumns({
        "available": F.col("grid_id").isNotNull(),
        "uhi_class": fn.heat_label(F.coalesce("mean_lst", "predicted_lst")), "aqi_class": aqi,
        "heat_risk": fn.class_risk(heat, ["Moderate", "Warm"], ["Hot", "Very Hot"]),
        "air_risk": fn.class_risk(aqi, ["Moderate"], ["Poor", "Very Poor", "Severe"]),
        "vegetation_risk": fn.vegetation_risk("mean_ndvi", "green_cover"), "density_risk": fn.density_risk("building_coverage_pct"),
    })


def cooling_potential(results: DataFrame) -> DataFrame:
    """Strongest cooling per cell over all scenarios and the scenario that gives it (name order on ties)."""
    return results.where(F.col("delta_lst").isNotNull()).groupBy("grid_id").agg(
        round_even(F.min("delta_lst"), 2).alias("max_cooling_c"), F.min_by("scenario", F.struct("delta_lst", "scenario")).alias("best_scenario"))


def cooling_classes(potential: DataFrame) -> DataFrame:
    """Quartile class of the cooling: the strongest quarter is VERY HIGH."""
    marked = attach_quantiles(potential, "_q", potential, "max_cooling_c", [0.25, 0.5, 0.75])
    pairs = [("VERY HIGH", 0), ("HIGH", 1), ("MODERATE", 2)]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, i in pairs:
        out = out.when(F.col("max_cooling_c") < F.col("_q")[i], F.lit(label))
    return marked.withColumn("cooling_class", out.otherwise(F.lit("LOW"))).drop("_q")


def top_cells_per_scenario(results: DataFrame, n: int) -> DataFrame:
    return top_n(results, ["scenario"], [F.col("delta_lst"), F.col("grid_id")], n)


def interventions(results: DataFrame, cells: DataFrame, per_scenario: int = 5) -> DataFrame:
    """The strongest cells of every scenario with their temperature before and after."""
    best = top_cells_per_scenario(results, per_scenario)  # a few rows per scenario
    joined = cells.select("grid_id", "mean_lst").join(F.broadcast(best), "grid_id")
    cooling = round_even("delta_lst", 2)
    return joined.select("scenario", "grid_id", F.col("mean_lst").alias("current_lst"), cooling.alias("cooling"),
                         round_even(F.col("mean_lst") + cooling, 2).alias("after_lst"))


def city_summary(cells: DataFrame, scenario_summary: DataFrame) -> DataFrame:
    """One row: means over the city, the hottest cell, the best scenario."""
    best = scenario_summary.agg(F.min_by(F.struct("scenario", "mean_delta_lst", "pct_cells_cooler"), F.struct("mean_delta_lst", "scenario")).alias("b")).select("b.*")
    main = cells.agg(
        F.avg("predicted_lst").alias("current_heat"), F.avg("mean_aqi").alias("aqi"), F.avg("mean_ndvi").alias("ndvi"),
        F.avg("building_coverage_pct").alias("urban_density"),
        F.min_by("grid_id", F.struct(-round_even("predicted_lst", 2), F.col("grid_id"))).alias("hottest_cell"), F.max("predicted_lst").alias("hottest_lst"))
    return attach_row(main, "_b", best).select(*main.columns, F.col("_b.scenario").alias("best_scenario"), F.col("_b.mean_delta_lst").alias("best_mean_delta"))


def explain_cells(cells: DataFrame, importance: DataFrame, features: Sequence[str] = K.ACTIONABLE_FEATURES) -> DataFrame:
    """Per cell and feature: value against the city mean, with the feature's importance."""
    have = [f for f in features if f in cells.columns]
    long = unpivot_columns(cells, ["grid_id"], have, "feature", "value").where(F.col("value").isNotNull())
    table = long.groupBy("feature").agg(F.avg("value").alias("city_mean")).join(importance, "feature")  # one row per feature
    cooler = F.col("feature").isin("mean_ndvi", "green_cover", "tree_density", "green_to_built", "dist_to_park")
    return long.join(F.broadcast(table), "feature").select(
        "grid_id", "feature", "value", "city_mean", F.when(F.col("value") > F.col("city_mean"), F.lit("above")).otherwise(F.lit("below")).alias("direction"),
        (~cooler).alias("hotter_when_high"), "importance")


def importance_share(contributions: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature and its percentage of the whole."""
    long = unpivot_columns(contributions, ids, features, "feature", "value")
    means = long.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    total = means.agg(F.sum("mean_abs").alias("t")).scalar()
    return means.withColumn("pct_importance", F.col("mean_abs") / total * F.lit(100.0))


def heat_stats(cells: DataFrame, lst: str) -> DataFrame:
    """60th percentile and population deviation of the temperature: the scale of the routing cost."""
    std = cells.agg(F.stddev_pop(lst).alias("std"))
    return attach_quantiles(std, "_q", cells, lst, [0.6]).select(F.col("_q")[0].alias("p60"), "std")


def route_statistics(path: DataFrame, by: Sequence[str] = ("route_id",)) -> DataFrame:
    """Length, walking time and temperatures of ordered paths (route_id, step, lon, lat, lst)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy("step")
    leg = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    metres = F.coalesce(F.sum("_leg"), F.lit(0.0))
    return path.withColumn("_leg", leg).groupBy(*by).agg(
        round_even(metres, 0).alias("distance_m"), round_even(metres / F.lit(1000.0) / F.lit(K.WALK_SPEED_KMH) * F.lit(60.0), 1).alias("time_min"),
        round_even(F.avg("lst"), 2).alias("avg_lst"), round_even(F.max("lst"), 2).alias("max_lst"), F.count(F.lit(1)).alias("n_cells"))


def _near(lon: Column, lat: Column, center: tuple[float, float], radius_m: float) -> Column:
    return haversine_m(F.lit(center[1]), F.lit(center[0]), lat, lon) <= F.lit(float(radius_m))


def area_statistics(polygons: DataFrame, roads: DataFrame, center: tuple[float, float], radius_m: float) -> DataFrame:
    """Counts and areas of building, green and water polygons (coords, layer, natural) and road length in a radius.

    A polygon counts when its vertex centroid is inside; a road piece (lon1, lat1, lon2, lat2) when either end is.
    """
    c = fn.vertex_centroid("coords")
    inside = polygons.withColumns({"_c": c, "_area": fn.polygon_area_m2("coords")}).where(_near(F.col("_c.x"), F.col("_c.y"), center, radius_m))
    layer = F.col("layer")
    area = lambda name: F.rint(F.coalesce(F.sum(F.when(layer == name, F.col("_area"))), F.lit(0.0)))
    stats = inside.agg(
        F.count_if(layer == "building").alias("buildings"), F.count_if(layer == "green").alias("green_count"), area("green").alias("green_area_m2"),
        F.count_if(layer == "water").alias("water_count"), area("water").alias("water_area_m2"),
        F.count_if((layer == "green") & F.lower("natural").isin(K.TREE_NATURAL)).alias("trees"))
    touching = _near(F.col("lon1"), F.col("lat1"), center, radius_m) | _near(F.col("lon2"), F.col("lat2"), center, radius_m)
    length = roads.where(touching).agg(round_even(F.coalesce(F.sum(haversine_m("lat1", "lon1", "lat2", "lon2")), F.lit(0.0)), 1).alias("road_length_m"))
    return attach_row(stats, "_r", length).select("*", F.col("_r.road_length_m")).drop("_r")
