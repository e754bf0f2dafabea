"""The cell x date table and what is asked of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from thermogrid import constants as K
from thermogrid.functions import local_season, span_years
from thermogrid.operators.keyed import global_row


def change_class(delta) -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return F.when(d > 0.5, F.lit("warming")).when(d < -0.5, F.lit("cooling")).when(d.isNotNull(), F.lit("unchanged"))


def training_rows(df: DataFrame, target: str, metadata: Sequence[str]) -> DataFrame:
    return df.where(F.col(target).isNotNull()).drop(*metadata)


def scene_quality(observations: DataFrame, min_fraction: float = 0.3) -> DataFrame:
    """Valid-cell fraction and status per scene."""
    counts = observations.groupBy("scene_id").agg(F.count(F.lit(1)).alias("total_cells"), F.count("lst_c").alias("valid_cells"))
    fraction = F.col("valid_cells") / F.col("total_cells")
    return counts.select("scene_id", "total_cells", "valid_cells", (F.rint(fraction * 1e4) / 1e4).alias("valid_fraction"),
                         F.when(fraction < min_fraction, F.lit("skipped_low_quality")).otherwise(F.lit("included")).alias("status"))


def usable_observations(observations: DataFrame, min_fraction: float = 0.3) -> DataFrame:
    kept = scene_quality(observations, min_fraction).where("status = 'included'").select("scene_id")
    return observations.join(kept, "scene_id", "left_semi")


def build_dataset(observations: DataFrame, static: DataFrame, weather: DataFrame, min_fraction: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """Scene temperatures of usable scenes with the static features of the cell and the weather of the day, at the scene's own station where `by` names it."""
    rows = usable_observations(observations, min_fraction).withColumn("season", local_season(F.col("date").cast("string")))
    return rows.join(static, "grid_id", "left").join(weather, [*by, "date"], "left")


def compare_dates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per-cell change for cells with a value on both dates."""
    a = first.select("grid_id", F.col("lst_c").alias("lst_a")).where(F.col("lst_a").isNotNull())
    b = second.select("grid_id", F.col("lst_c").alias("lst_b")).where(F.col("lst_b").isNotNull())
    delta = F.col("lst_b") - F.col("lst_a")
    return a.join(b, "grid_id").select("grid_id", "lst_a", "lst_b", delta.alias("delta"), change_class(delta).alias("change"))


def catalogue_summary(scenes: DataFrame) -> DataFrame:
    s = scenes.agg(F.count(F.lit(1)).alias("scene_count"), F.min("date").alias("first_date"), F.max("date").alias("latest_date"))
    years = F.when(F.col("scene_count") >= 2, span_years("first_date", "latest_date")).otherwise(F.lit(0.0))
    return s.withColumn("date_range_years", years)


def dates_per_season(scenes: DataFrame) -> DataFrame:
    season = local_season(F.col("date").cast("string"))
    return scenes.groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"))


def thermal_analytics(scenes: DataFrame) -> DataFrame:
    return scenes.agg(
        F.count(F.lit(1)).alias("observation_count"), F.avg("mean_lst").alias("mean_lst"),
        F.min_by("date", F.struct(-F.col("max_lst"), F.col("date"))).alias("hottest_date"), F.max("max_lst").alias("hottest_max_lst"),
        F.min_by("date", F.struct("min_lst", "date")).alias("coolest_date"), F.min("min_lst").alias("coolest_min_lst"),
    )


def seasonal_comparison(scenes: DataFrame, min_total: int = 4, min_per_season: int = 2) -> DataFrame:
    """One row per season; too few observations, overall or in the season, give no mean."""
    season = local_season(F.col("date").cast("string"))
    stats = scenes.groupBy(season.alias("season")).agg(F.count(F.lit(1)).alias("n"), F.avg("mean_lst").alias("m"))
    names = scenes.sparkSession.createDataFrame([(s,) for s in K.LOCAL_SEASONS], "season string")
    total = scenes.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    enough = (n >= min_per_season) & (total >= min_total)
    return names.join(F.broadcast(stats), "season", "left").select(
        "season", n.alias("n"), F.when(enough, F.lit("available")).otherwise(F.lit("insufficient_data")).alias("status"),
        F.when(enough, F.col("m")).alias("mean_lst"))


def dataset_report(df: DataFrame, weather_columns: Sequence[str]) -> DataFrame:
    complete = F.lit(True)
    for c in weather_columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("lst_c").alias("valid_lst_rows"), F.count_if(complete).alias("valid_weather_rows"),
        F.count_if(complete & F.col("lst_c").isNotNull()).alias("complete_rows"),
        F.count_distinct("date").alias("dates"), F.count_distinct("grid_id").alias("cells"), F.count_distinct("scene_id").alias("scenes"))


def season_report(df: DataFrame) -> DataFrame:
    """Rows, dates and cells of each season of the dataset."""
    return df.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates"), F.count_distinct("grid_id").alias("cells"))


def scene_report(observations: DataFrame, min_fraction: float = 0.3) -> DataFrame:
    """How many scenes went in and how many were left out, with their cells."""
    return scene_quality(observations, min_fraction).groupBy("status").agg(
        F.count(F.lit(1)).alias("scenes"), F.sum("total_cells").alias("total_cells"), F.sum("valid_cells").alias("valid_cells"))


def footprint_covers(bounds: tuple[float, float, float, float], tolerance: float = 1e-7) -> Column:
    x0, y0, x1, y1 = bounds
    return (
        (F.col("xmin") - tolerance <= x0) & (F.col("ymin") - tolerance <= y0)
        & (F.col("xmax") + tolerance >= x1) & (F.col("ymax") + tolerance >= y1)
    )


def newest_clean_scene(scenes: DataFrame, bounds: tuple[float, float, float, float], max_cloud: float) -> DataFrame:
    usable = scenes.where(F.col("cloud_cover").isNull() | (F.col("cloud_cover") < max_cloud)).where(footprint_covers(bounds))
    return usable.orderBy(F.desc("date"), "scene_id").limit(1)


def latest_observation(scenes: DataFrame) -> DataFrame:
    row = F.max_by(F.struct(*[c for c in scenes.columns if c != "date"], "date"), F.struct("date", "scene_id"))
    return scenes.agg(row.alias("r")).select("r.*")


def compare_models(first: DataFrame, second: DataFrame) -> DataFrame:
    """Metric by metric: how much better the second model is, and whether to deploy it (lower RMSE wins)."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot([], ["rmse", "mae", "r2"], "metric", name)

    joined = long(first.select("rmse", "mae", "r2"), "v1").join(F.broadcast(long(second.select("rmse", "mae", "r2"), "v2")), "metric")
    better = F.when(F.col("metric") == "r2", F.col("v2") - F.col("v1")).otherwise(F.col("v1") - F.col("v2"))
    pct = F.when(F.col("metric") != "r2", F.when(F.col("v1") != 0, better / F.col("v1") * F.lit(100.0)).otherwise(F.lit(0.0)))
    choice = global_row(first.select(F.col("rmse").alias("a")))["a"] > global_row(second.select(F.col("rmse").alias("b")))["b"]
    return joined.select("metric", "v1", "v2", better.alias("improvement"), pct.alias("improvement_pct"),
                         F.when(choice, F.lit("DEPLOY_V2")).otherwise(F.lit("KEEP_V1")).alias("recommendation"))
