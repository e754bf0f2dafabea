"""The grid feature table: assembly, derived indices, cleaning, validation, encoding, live overrides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from thermogrid import constants as K, functions as fn
from thermogrid.operators.keyed import attach_row, drop_duplicate_rows
from thermogrid.operators.stats import (
    attach_quantiles, describe_columns, drop_sparse_columns, median_fill_values, mode_fill_values, unpivot_columns,
)


def inside_bounds(observations: DataFrame, bounds: tuple[float, float, float, float], margin: float = 0.05) -> DataFrame:
    x0, y0, x1, y1 = bounds
    return observations.where(F.col("lat").between(y0 - margin, y1 + margin) & F.col("lon").between(x0 - margin, x1 + margin))


def clean_observations(observations: DataFrame, bounds: tuple[float, float, float, float], pollutants: Sequence[str]) -> DataFrame:
    """Inside the bounds, positive concentrations only, at least one pollutant left."""
    kept = inside_bounds(observations, bounds).withColumns({p: fn.positive_or_null(p) for p in pollutants})
    return kept.na.drop(how="all", subset=list(pollutants))


def assemble(cells: DataFrame, frames: Sequence[DataFrame], weather: DataFrame) -> DataFrame:
    """Feature frames joined to the cells on grid_id, the single weather row on every cell."""
    out = cells
    for f in frames:
        out = out.join(f, "grid_id", "left")
    if "green_space_pct" in out.columns:
        out = out.withColumn("green_space_pct", fn.clip("green_space_pct", 0.0, 100.0))
    return attach_row(out, "_w", weather).withColumns({c: F.col("_w")[c] for c in weather.columns}).drop("_w")


def derived_indices(cells: DataFrame) -> DataFrame:
    """The seven indices and the target. City-wide ranges and percentiles are scalars computed once."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ranges = cells.agg(*[
        a for c in ("road_density", "mean_slope", "building_density")
        for a in (F.min(zero(c)).alias(f"{c}_lo"), F.max(zero(c)).alias(f"{c}_hi"))
    ])
    marked = attach_quantiles(attach_row(cells, "_b", ranges), "_q", cells, "mean_ndvi", K.NDVI_SCALE_QUANTILES)
    bounds, p2, p98 = F.col("_b"), F.col("_q")[0], F.col("_q")[1]
    first = marked.withColumns({
        "impervious_surface_ratio": fn.impervious_surface_ratio("lc_builtup_pct", "lc_bare_pct"),
        "green_to_built_ratio": fn.green_to_built_ratio("lc_vegetation_pct", "lc_builtup_pct"),
        "cooling_distance_index": fn.cooling_distance_index("dist_to_park", "dist_to_water", "green_space_pct"),
        "road_exposure_index": fn.road_exposure_index("road_density", "dist_to_major_road", bounds["road_density_lo"], bounds["road_density_hi"]),
        "vegetation_cooling_index": fn.vegetation_cooling_index("mean_ndvi", "green_cover", p2, p98),
        "terrain_exposure_index": fn.terrain_exposure_index("mean_slope", bounds["mean_slope_lo"], bounds["mean_slope_hi"]),
    })
    return first.withColumns({
        "heat_vulnerability_index": fn.heat_vulnerability_index(
            "impervious_surface_ratio", "green_space_pct", "building_density", "road_exposure_index", "mean_ndvi",
            bounds["building_density_lo"], bounds["building_density_hi"], p2, p98),
        "target_lst": F.col("mean_lst"),
    }).drop("_b", "_q")


def clean_dataset(df: DataFrame, id_column: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Duplicates out, columns missing over half out, medians and modes in."""
    once = drop_duplicate_rows(df, id_column, [*numeric, *categorical])
    kept = drop_sparse_columns(once, [*numeric, *categorical], K.MAX_MISSING_PCT)
    fitted = fit_preprocessor(kept, [c for c in numeric if c in kept.columns], [c for c in categorical if c in kept.columns], encode=False)
    return apply_preprocessor(kept, fitted)


# --- validation --------------------------------------------------------------------------------------


def validate_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds `reasons`: one entry per feature that is missing or not finite; an empty list means valid."""
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"missing features: {absent}")
    checks = [
        F.when(F.col(c).isNull(), F.lit(f"{c} missing")).when(fn.finite(F.col(c)).isNull(), F.lit(f"{c} not finite")) for c in features
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    checked = validate_rows(df, features)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


# --- imputation and encoding --------------------------------------------------------------------------


@dataclass(frozen=True)
class Preprocessor:
    """`fill` holds one number per column; `codes` is a table (column, value, code) of any size."""

    fill: dict[str, float]
    codes: DataFrame | None = None
    encoded: tuple[str, ...] = ()


def fit_preprocessor(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], encode: bool = True) -> Preprocessor:
    """Medians, modes and label codes (the rank of a value among the column's values). One number per column leaves the cluster."""
    fill = {r["column"]: r["fill"] for r in median_fill_values(df, numeric).collect()} if numeric else {}
    modes = {r["column"]: r["fill"] for r in mode_fill_values(df, categorical).collect()} if categorical else {}
    codes = None
    if encode and categorical:
        pairs = unpivot_columns(df, [], categorical).where(F.col("value").isNotNull()).distinct()
        rank = F.row_number().over(W.partitionBy("column").orderBy("value")) - 1
        codes = pairs.select("column", "value", rank.cast("double").alias("code"))
    return Preprocessor({**fill, **modes}, codes, tuple(c for c in categorical if c in modes) if encode else ())


def apply_preprocessor(df: DataFrame, fitted: Preprocessor) -> DataFrame:
    """Fill, then encode; a value never seen in fitting takes the code of the most frequent one."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fitted.fill.items() if c in df.columns})
    for c in fitted.encoded:
        if c in df.columns:
            known = fitted.codes.where(F.col("column") == c)
            common = known.where(F.col("value") == fitted.fill[c]).select("code").scalar()
            table = known.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            filled = filled.join(table, filled[c] == table["_value"], "left").withColumn(c, F.coalesce("_code", common)).drop("_value", "_code")
    return filled


# --- live values and provenance -----------------------------------------------------------------------


def override_columns(cells: DataFrame, live: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns on every cell by the values of a one-row table; an absent live value keeps the stored one."""
    row = F.col("_live")
    return attach_row(cells, "_live", live.select(*columns)).withColumns({c: F.coalesce(row[c], F.col(c)) for c in columns}).drop("_live")


def feature_provenance(cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """Source and status of each feature with the number of cells that carry it."""
    present = describe_columns(cells, features, {"present": F.count})
    rows = [(f, s, st) for f, (s, st) in K.FEATURE_PROVENANCE.items()]
    table = cells.sparkSession.createDataFrame(rows, "column string, source string, status string")
    return present.join(F.broadcast(table), "column", "left").select(
        F.col("column").alias("feature"), F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("status", F.lit("UNAVAILABLE")).alias("status"), "present")
