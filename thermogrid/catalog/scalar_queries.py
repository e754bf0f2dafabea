"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid import constants as K, functions as fn
from thermogrid.catalog.registry import query
from thermogrid.functions import round_even
from thermogrid.operators.raster import aspect_direction
from thermogrid.operators.stats import attach_quantiles, quantile_columns, unpivot_columns
from thermogrid.plans import feature_table as T, scenario as SC


def r6(*names):
    return [round_even(n, 6).alias(n) for n in names]


def aqi_case(c: str, pollutant: str, open_top: bool = False) -> str:
    """SQL CASE for one pollutant's bands; above the top one the top index holds, or nothing with `open_top`."""
    parts = []
    for lo, hi, a, b in K.AQI_BANDS[pollutant]:
        top = float(hi) if hi is not None else lo * 2.0
        parts.append(f"WHEN {c} >= {float(lo)}e0 AND {c} <= {top}e0 THEN {float(a)}e0 + {float(b - a)}e0 * (({c} - {float(lo)}e0) / {top - float(lo)!r}e0)")
    if not open_top:
        parts.append(f"WHEN {c} > {top}e0 THEN {float(b)}e0")
    return "CASE " + " ".join(parts) + " END"


@query("coordinate_filter_P1", "SELECT station_id FROM stations WHERE lat BETWEEN 20.15e0 - 0.05e0 AND 20.25e0 + 0.05e0 AND lon BETWEEN 85.8e0 - 0.05e0 AND 85.85e0 + 0.05e0")
def _(d):
    return T.inside_bounds(d.stations, (85.80, 20.15, 85.85, 20.25)).select("station_id")


@query("positive_concentration_P2", "SELECT station_id, CASE WHEN pm25 > 0 THEN pm25 END AS pm25, CASE WHEN pm10 > 0 THEN pm10 END AS pm10, CASE WHEN co > 0 THEN co END AS co FROM stations")
def _(d):
    return d.stations.select("station_id", *[fn.positive_or_null(c).alias(c) for c in ("pm25", "pm10", "co")])


@query("drop_all_null_P3", """
    SELECT station_id FROM stations WHERE NOT (pm25 <= 0 AND no2 <= 400)""")
def _(d):
    s = d.stations.select("station_id", fn.positive_or_null("pm25").alias("pm25"), F.when(F.col("no2") > 400, F.col("no2")).alias("no2"))
    return s.na.drop(how="all", subset=["pm25", "no2"]).select("station_id")


@query("qa_bitmask_P4", "SELECT row_id, col_id, qa, (qa & 31) <> 0 AS masked FROM pixels")
def _(d):
    return d.pixels.select("row_id", "col_id", "qa", fn.qa_masked("qa").alias("masked"))


@query("dn_to_lst_P5", "SELECT row_id, col_id, R6(CASE WHEN dn <> 0 AND (qa & 31) = 0 THEN dn * 0.00341802e0 + 149.0e0 - 273.15e0 END) AS lst_c FROM pixels")
def _(d):
    return d.pixels.select("row_id", "col_id", round_even(F.when(~fn.qa_masked("qa"), fn.dn_to_lst("dn")), 6).alias("lst_c"))


@query("scene_scale_override_P6", """
    SELECT p.row_id, p.col_id, R6(CASE WHEN p.dn <> 0 THEN p.dn * coalesce(s.scale_mul, 0.00341802e0) + coalesce(s.scale_add, 149.0e0) - 273.15e0 END) AS lst_c
    FROM pixels p LEFT JOIN scenes s ON s.scene_key = p.scene_key""")
def _(d):
    joined = d.pixels.join(d.scenes.select("scene_key", "scale_mul", "scale_add"), "scene_key", "left")
    return joined.select("row_id", "col_id", round_even(fn.dn_to_lst("dn", "scale_mul", "scale_add"), 6).alias("lst_c"))


@query("dn_to_reflectance_P7", "SELECT row_id, col_id, R6(CASE WHEN red_dn <> 0 THEN red_dn * 0.0001e0 END) AS red, R6(CASE WHEN nir_dn <> 0 THEN nir_dn * 0.0001e0 END) AS nir FROM pixels")
def _(d):
    return d.pixels.select("row_id", "col_id", round_even(fn.dn_to_reflectance("red_dn"), 6).alias("red"), round_even(fn.dn_to_reflectance("nir_dn"), 6).alias("nir"))


@query("missing_flag_units_P8", "SELECT date, R6(ws2m) AS ws2m, R6(rh2m * 10.0e0) AS ps, R6(t2m * (1000.0e0 / 24.0e0)) AS radiation FROM weather_long")
def _(d):
    flagged = d.weather_long.withColumn("ws2m", F.coalesce("ws2m", F.lit(-999.0)))
    f = K.WEATHER_UNIT_FACTORS
    return flagged.select("date", round_even(fn.flag_to_null("ws2m", K.WEATHER_MISSING_FLAG), 6).alias("ws2m"),
                          round_even(fn.flag_to_null("rh2m", -999.0) * F.lit(f["ps"]), 6).alias("ps"),
                          round_even(fn.flag_to_null("t2m", -999.0) * F.lit(f["allsky_sfc_sw_dwn"]), 6).alias("radiation"))


@query("radiation_to_watts_P9", "SELECT date, round_even(t2m * 1e6 / 86400.0e0 * 100.0e0, 0) / 100.0e0 AS watts FROM weather_long")
def _(d):
    return d.weather_long.select("date", fn.radiation_to_watts("t2m").alias("watts"))


@query("ndvi_P10", "SELECT row_id, col_id, R6(CASE WHEN nir_dn + red_dn > 0 THEN greatest(-1.0e0, least(1.0e0, (nir_dn - red_dn) / (nir_dn + red_dn * 1.0e0))) END) AS ndvi FROM pixels")
def _(d):
    return d.pixels.select("row_id", "col_id", round_even(fn.ndvi("nir_dn", "red_dn"), 6).alias("ndvi"))


@query("green_cover_flag_P11", "SELECT row_id, col_id, CASE WHEN ndvi > 0.3e0 THEN 1 ELSE 0 END AS green FROM ndvi_pixels")
def _(d):
    return d.ndvi_pixels.select("row_id", "col_id", fn.green_cover_flag("ndvi").alias("green"))


@query("break_classifier_P12", """
    SELECT row_id, col_id, CASE WHEN ndvi IS NULL THEN 0 WHEN ndvi >= 0.6e0 THEN 5 WHEN ndvi >= 0.4e0 THEN 4 WHEN ndvi >= 0.2e0 THEN 3 WHEN ndvi >= 0.1e0 THEN 2 ELSE 1 END AS density
    FROM ndvi_pixels""")
def _(d):
    return d.ndvi_pixels.select("row_id", "col_id", fn.veg_density_class("ndvi").alias("density"))


@query("land_cover_rules_P13", """
    SELECT row_id, col_id, CASE WHEN ndvi IS NULL THEN 0 WHEN ndvi < 0.05e0 THEN 1 WHEN ndvi >= 0.3e0 THEN 2 WHEN ndvi < 0.15e0 THEN 3 ELSE 4 END AS land_cover
    FROM ndvi_pixels""")
def _(d):
    return d.ndvi_pixels.select("row_id", "col_id", fn.land_cover_class("ndvi").alias("land_cover"))


@query("heat_class_quantiles_P14", """
    WITH b AS (SELECT quantile_cont(lst_c, 0.15) AS a1, quantile_cont(lst_c, 0.35) AS a2, quantile_cont(lst_c, 0.55) AS a3,
                      quantile_cont(lst_c, 0.75) AS a4, quantile_cont(lst_c, 0.9) AS a5 FROM lst_pixels)
    SELECT row_id, col_id, CASE WHEN lst_c IS NULL THEN 0 ELSE 1 + (lst_c >= a1)::INT + (lst_c >= a2)::INT + (lst_c >= a3)::INT
      + (lst_c >= a4)::INT + (lst_c >= a5)::INT END AS heat_class,
      CASE WHEN lst_c IS NULL THEN 0 ELSE 1 + (lst_c >= 20)::INT + (lst_c >= 25)::INT + (lst_c >= 30)::INT + (lst_c >= 35)::INT + (lst_c >= 40)::INT END AS fixed_class
    FROM lst_pixels, b""")
def _(d):
    breaks = [F.col("_q")[i] for i in range(5)]
    return attach_quantiles(d.lst_pixels, "_q", d.lst_pixels, "lst_c", K.HEAT_QUANTILES).select("row_id", "col_id", fn.classify_breaks("lst_c", breaks).alias("heat_class"), fn.heat_class_fixed("lst_c").alias("fixed_class"))


@query("heat_label_P15", """
    SELECT grid_id, CASE WHEN mean_lst < 20 THEN 'Very Cool' WHEN mean_lst < 25 THEN 'Cool' WHEN mean_lst < 30 THEN 'Moderate'
      WHEN mean_lst < 35 THEN 'Warm' WHEN mean_lst < 40 THEN 'Hot' ELSE 'Very Hot' END AS heat FROM cells""")
def _(d):
    return d.cells.select("grid_id", fn.heat_label("mean_lst").alias("heat"))


_AQI_CASE = """CASE WHEN mean_aqi IS NULL THEN NULL WHEN mean_aqi <= 50 THEN 'Good' WHEN mean_aqi <= 100 THEN 'Satisfactory' WHEN mean_aqi <= 200 THEN 'Moderate'
      WHEN mean_aqi <= 300 THEN 'Poor' WHEN mean_aqi <= 400 THEN 'Very Poor' ELSE 'Severe' END"""


@query("aqi_category_upper_P16", f"SELECT grid_id, {_AQI_CASE} AS category FROM cells")
def _(d):
    return d.cells.select("grid_id", fn.aqi_category("mean_aqi").alias("category"))


@query("aqi_category_code_P17", """
    SELECT grid_id, CASE WHEN mean_aqi IS NULL THEN 0 WHEN mean_aqi >= 401 THEN 6 WHEN mean_aqi >= 301 THEN 5 WHEN mean_aqi >= 201 THEN 4
      WHEN mean_aqi >= 101 THEN 3 WHEN mean_aqi >= 51 THEN 2 WHEN mean_aqi >= 0 THEN 1 ELSE 0 END AS code FROM cells""")
def _(d):
    return d.cells.select("grid_id", fn.aqi_category_code("mean_aqi").alias("code"))


def _subindex(key: str, factor: float, open_top: bool):
    @query(key, f"SELECT station_id, R6({aqi_case(f'(pm25 * {factor}e0)', 'pm25', open_top)}) AS pm25_index, R6({aqi_case(f'(o3 * {factor}e0)', 'o3', open_top)}) AS o3_index FROM stations")
    def _(d):
        pm25, o3 = (fn.aqi_subindex(F.col(c) * factor, c, open_top) for c in ("pm25", "o3"))
        return d.stations.select("station_id", round_even(pm25, 6).alias("pm25_index"), round_even(o3, 6).alias("o3_index"))


# The literal rule, and concentrations high enough to pass the top band with the top index held.
_subindex("aqi_subindex_P18", 1.0, True)
_subindex("aqi_subindex_saturated_P18b", 4.0, False)


def composite_sql(open_top: bool) -> str:
    return "greatest(" + ", ".join(aqi_case(f"({p} / 1000.0e0)" if p == "co" else p, p, open_top) for p in K.POLLUTANTS) + ")"


COMPOSITE_SQL = composite_sql(False)


def _composite(key: str, open_top: bool):
    @query(key, f"SELECT station_id, R6({composite_sql(open_top)}) AS aqi FROM stations")
    def _(d):
        return d.stations.select("station_id", round_even(fn.composite_aqi({p: p for p in K.POLLUTANTS}, open_top), 6).alias("aqi"))


_composite("composite_aqi_P19", True)
_composite("composite_aqi_saturated_P19b", False)


NOAA_SQL = """
    WITH w AS (SELECT site, date, t2m * 9.0e0 / 5.0e0 + 32.0e0 AS t, CASE WHEN rh2m < 0 THEN 0.0e0 ELSE rh2m END AS h FROM weather_daily),
    f AS (SELECT *, -42.379e0 + 2.04901523e0 * t + 10.14333127e0 * h - 0.22475541e0 * t * h - 0.00683783e0 * t * t
      - 0.05481717e0 * h * h + 0.00122874e0 * t * t * h + 0.00085282e0 * t * h * h - 0.00000199e0 * t * t * h * h AS full_index FROM w),
    a AS (SELECT *, CASE WHEN h < 13 AND t BETWEEN 80 AND 112 THEN full_index - ((13 - h) / 4) * sqrt((17 - abs(t - 95)) / 17)
      WHEN h > 85 AND t BETWEEN 80 AND 87 THEN full_index + ((h - 85) / 10) * ((87 - t) / 5) ELSE full_index END AS adjusted FROM f),
    heat AS (SELECT site, date, (CASE WHEN t < 80 OR h < 40 THEN 0.5e0 * (t + 61.0e0 + (t - 68.0e0) * 1.2e0 + h * 0.094e0) ELSE adjusted END - 32) * 5.0e0 / 9.0e0 AS heat_index FROM a)
"""


@query("noaa_heat_index_P20", NOAA_SQL + "SELECT site, date, R6(heat_index) AS heat_index FROM heat")
def _(d):
    return d.weather_daily.select("site", "date", round_even(fn.heat_index_noaa("t2m", "rh2m"), 6).alias("heat_index"))


@query("short_heat_index_P21", """
    SELECT site, date, CASE WHEN t2m < 27 OR rh2m < 40 THEN R6(t2m) ELSE floor((-8.78469475556e0 + 1.61139411e0 * t2m + 2.33854883889e0 * rh2m
      - 0.14611605e0 * t2m * rh2m - 0.012308094e0 * t2m * t2m - 0.0164248277778e0 * rh2m * rh2m + 0.002211732e0 * t2m * t2m * rh2m
      + 0.00072546e0 * t2m * rh2m * rh2m - 0.000003582e0 * t2m * t2m * rh2m * rh2m) * 10.0e0 + 0.5e0) / 10.0e0 END AS heat_index FROM weather_daily""")
def _(d):
    return d.weather_daily.select("site", "date", round_even(fn.heat_index_short("t2m", "rh2m"), 6).alias("heat_index"))


@query("meteo_season_P22", """
    SELECT date, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) IN (3, 4, 5) THEN 'MAM' WHEN month(date) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season FROM weather_long""")
def _(d):
    return d.weather_long.select("date", fn.meteo_season("date").alias("season"))


@query("monsoon_season_P23", """
    SELECT date, CASE WHEN extract(day FROM date) = 13 THEN 'unknown' WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'pre_monsoon'
      WHEN month(date) IN (6, 7, 8, 9) THEN 'monsoon' ELSE 'post_monsoon' END AS season FROM weather_long""")
def _(d):
    text = F.when(F.dayofmonth("date") == 13, F.lit("not a date")).otherwise(F.col("date").cast("string"))
    return d.weather_long.select("date", fn.local_season(text).alias("season"))


@query("surface_ratios_P24", """
    SELECT grid_id, R6(least(1.0e0, greatest(0.0e0, (coalesce(lc_builtup_pct, 0) + lc_bare_pct) / 100.0e0))) AS impervious,
      R4((lc_vegetation_pct + 1e-6) / (coalesce(lc_builtup_pct, 0) + 1e-6)) AS green_to_built FROM cells""")
def _(d):
    return d.cells.select("grid_id", round_even(fn.impervious_surface_ratio("lc_builtup_pct", "lc_bare_pct"), 6).alias("impervious"),
                          round_even(fn.green_to_built_ratio("lc_vegetation_pct", "lc_builtup_pct"), 4).alias("green_to_built"))


@query("proximity_P25", """
    SELECT grid_id, R6(coalesce(1.0e0 / (1.0e0 + dist_to_major_road / 500.0e0), 0.0e0)) AS proximity,
      least(dist_to_water, dist_to_major_road) AS nearest, CASE WHEN mean_ndvi IS NOT NULL THEN R6(least(1.0e0, greatest(0.0e0, mean_ndvi * 2.0e0))) END AS clipped FROM cells""")
def _(d):
    return d.cells.select("grid_id", round_even(fn.proximity("dist_to_major_road"), 6).alias("proximity"),
                          fn.null_tolerant_min("dist_to_water", "dist_to_major_road").alias("nearest"),
                          round_even(fn.clip01(F.col("mean_ndvi") * 2.0), 6).alias("clipped"))


_COOL = "least(1.0e0, greatest(0.0e0, 0.5e0 * (1.0e0 / (1.0e0 + least(dist_to_park, dist_to_water) / 500.0e0)) + 0.5e0 * (green_space_pct / 100.0e0)))"
_ROAD = """least(1.0e0, greatest(0.0e0, 0.5e0 * ((coalesce(road_density, 0) - rlo) / (rhi - rlo)) + 0.5e0 * (1.0e0 - coalesce(1.0e0 / (1.0e0 + dist_to_major_road / 500.0e0), 0.0e0))))"""
_NSC = "least(1.0e0, greatest(0.0e0, (mean_ndvi - p2) / (p98 - p2)))"
_STATS = """
    WITH s AS (SELECT min(coalesce(road_density, 0)) AS rlo, max(coalesce(road_density, 0)) AS rhi, quantile_cont(mean_ndvi, 0.02) AS p2,
      quantile_cont(mean_ndvi, 0.98) AS p98, min(mean_slope) AS slo, max(mean_slope) AS shi, min(building_density) AS blo, max(building_density) AS bhi FROM cells)
"""


@query("cooling_distance_index_P26", f"SELECT grid_id, R6({_COOL}) AS cooling_distance_index FROM cells")
def _(d):
    return d.cells.select("grid_id", round_even(fn.cooling_distance_index("dist_to_park", "dist_to_water", "green_space_pct"), 6).alias("cooling_distance_index"))


def _derived(d):
    return T.derived_indices(d.cells)


@query("road_exposure_index_P27", _STATS + f"SELECT grid_id, R6({_ROAD}) AS road_exposure_index FROM cells, s")
def _(d):
    return _derived(d).select("grid_id", *r6("road_exposure_index"))


@query("vegetation_cooling_index_P28", _STATS + f"SELECT grid_id, CASE WHEN mean_ndvi IS NOT NULL THEN R6({_NSC} * (green_cover / 100.0e0)) END AS vegetation_cooling_index FROM cells, s")
def _(d):
    return _derived(d).select("grid_id", *r6("vegetation_cooling_index"))


@query("terrain_exposure_index_P29", _STATS + "SELECT grid_id, R6((mean_slope - slo) / (shi - slo)) AS terrain_exposure_index FROM cells, s")
def _(d):
    return _derived(d).select("grid_id", *r6("terrain_exposure_index"))


@query("heat_vulnerability_index_P30", _STATS + f"""
    SELECT grid_id, CASE WHEN mean_ndvi IS NOT NULL THEN R6(least(1.0e0, greatest(0.0e0,
      0.3e0 * least(1.0e0, (coalesce(lc_builtup_pct, 0) + lc_bare_pct) / 100.0e0) + 0.25e0 * (1.0e0 - green_space_pct / 100.0e0)
      + 0.2e0 * ((building_density - blo) / (bhi - blo)) + 0.15e0 * {_ROAD} + 0.1e0 * least(1.0e0, greatest(0.0e0, 1.0e0 - (mean_ndvi - p2) / (p98 - p2)))))) END AS heat_vulnerability_index
    FROM cells, s""")
def _(d):
    return _derived(d).select("grid_id", *r6("heat_vulnerability_index"))


@query("risk_levels_P31", """
    SELECT grid_id, CASE WHEN mean_lst >= 35 THEN 'High' WHEN mean_lst >= 25 THEN 'Moderate' ELSE 'Low' END AS heat_level,
      CASE WHEN mean_aqi IS NULL THEN 'na' WHEN mean_aqi > 200 THEN 'high' WHEN mean_aqi > 100 THEN 'moderate' ELSE 'low' END AS air_tone,
      CASE WHEN mean_ndvi < 0.2 THEN 'High' WHEN mean_ndvi < 0.4 THEN 'Moderate' WHEN mean_ndvi IS NOT NULL THEN 'Low'
           WHEN green_cover < 20 THEN 'High' WHEN green_cover < 40 THEN 'Moderate' ELSE 'Low' END AS vegetation_level,
      CASE WHEN building_coverage_pct >= 60 THEN 'High' WHEN building_coverage_pct >= 30 THEN 'Moderate' ELSE 'Low' END AS density_level
    FROM cells""")
def _(d):
    heat = fn.class_risk(fn.heat_label("mean_lst"), ["Moderate", "Warm"], ["Hot", "Very Hot"])
    air = fn.class_risk(fn.aqi_category("mean_aqi"), ["Moderate"], ["Poor", "Very Poor", "Severe"])
    return d.cells.select("grid_id", heat["level"].alias("heat_level"), air["tone"].alias("air_tone"),
                          fn.vegetation_risk("mean_ndvi", "green_cover")["level"].alias("vegetation_level"),
                          fn.density_risk("building_coverage_pct")["level"].alias("density_level"))


@query("risk_score_P32", """
    WITH l AS (SELECT grid_id, CASE WHEN mean_lst >= 35 THEN 1.0e0 WHEN mean_lst >= 25 THEN 0.5e0 ELSE 0.0e0 END AS a,
      CASE WHEN green_cover >= 35 THEN 0.0e0 WHEN green_cover >= 15 THEN 0.5e0 ELSE 1.0e0 END AS b,
      CASE WHEN building_density >= 800 THEN 1.0e0 WHEN building_density >= 400 THEN 0.5e0 ELSE 0.0e0 END AS c FROM cells)
    SELECT grid_id, R6((a + b + c + 0.0e0) / 4.0e0) AS score, CASE WHEN (a + b + c) / 4.0e0 >= 0.66e0 THEN 'High' WHEN (a + b + c) / 4.0e0 >= 0.33e0 THEN 'Moderate' ELSE 'Low' END AS band FROM l""")
def _(d):
    heat = fn.class_risk(fn.heat_label("mean_lst"), ["Moderate", "Warm"], ["Hot", "Very Hot"])["level"]
    veg = F.when(F.col("green_cover") >= 35, F.lit("Low")).when(F.col("green_cover") >= 15, F.lit("Moderate")).otherwise(F.lit("High"))
    dens = F.when(F.col("building_density") >= 800, F.lit("High")).when(F.col("building_density") >= 400, F.lit("Moderate")).otherwise(F.lit("Low"))
    score = fn.risk_score(heat, veg, dens, F.lit("Low"))
    return d.cells.select("grid_id", round_even(score, 6).alias("score"), fn.risk_band(score).alias("band"))


@query("perturbation_P33", """
    SELECT grid_id, R6(greatest(-1.0e0, least(1.0e0, mean_ndvi + 0.4e0))) AS mean_ndvi_raw, R6(least(100.0e0, greatest(0.0e0, green_cover * 1.5e0))) AS green_cover,
      least(tree_count, 100.0e0) AS tree_count, greatest(dist_to_park, 800.0e0) AS dist_to_park,
      R6(greatest(0.0e0, impervious_ratio - 5.0e0)) AS impervious_ratio FROM cells WHERE mean_ndvi IS NOT NULL
    UNION ALL SELECT grid_id, NULL, R6(least(100.0e0, greatest(0.0e0, green_cover * 1.5e0))), least(tree_count, 100.0e0), greatest(dist_to_park, 800.0e0),
      R6(greatest(0.0e0, impervious_ratio - 5.0e0)) FROM cells WHERE mean_ndvi IS NULL""")
def _(d):
    out = SC.perturb(d.cells, {"mean_ndvi": ("add", 0.4), "green_cover": ("mul", 1.5), "tree_count": ("min", 100.0),
                               "dist_to_park": ("max", 800.0), "impervious_ratio": ("add", -5.0), "no_such_column": ("add", 1.0)})
    return out.select("grid_id", round_even("mean_ndvi", 6).alias("mean_ndvi_raw"), *r6("green_cover"), "tree_count", "dist_to_park", *r6("impervious_ratio"))


def scenario_rows_sql() -> str:
    rows = [f"('{s}', '{f}', '{k}', {v}e0)" for s, m in K.SCENARIOS.items() for f, (k, v) in m.items()]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(scenario, feature, kind, value)"


@query("standard_scenarios_P34", f"""
    WITH sc AS ({scenario_rows_sql()}),
    l AS (SELECT 'green_cover' AS feature, green_cover AS v FROM cells UNION ALL SELECT 'tree_count', tree_count FROM cells UNION ALL
          SELECT 'dist_to_park', dist_to_park FROM cells UNION ALL SELECT 'building_density', building_density FROM cells)
    SELECT scenario, sc.feature, kind, value, R4(avg(CASE WHEN kind = 'add' THEN v + value ELSE v * value END)) AS unclamped_mean
    FROM sc JOIN l ON l.feature = sc.feature GROUP BY scenario, sc.feature, kind, value""")
def _(d):
    long = unpivot_columns(d.cells, [], ["green_cover", "tree_count", "dist_to_park", "building_density"], "feature", "v")
    means = long.groupBy("feature").agg(F.avg("v").alias("m"))
    rows = SC.scenario_table(d.spark).join(F.broadcast(means), "feature")
    shifted = F.when(F.col("kind") == "add", F.col("m") + F.col("value")).otherwise(F.col("m") * F.col("value"))
    return rows.select("scenario", "feature", "kind", "value", round_even(shifted, 4).alias("unclamped_mean"))


@query("tree_planting_P35", """
    SELECT grid_id, tree_count + 120.0e0 AS tree_count, R6(least(100.0e0, tree_density + 24.0e0)) AS tree_density, R6(least(1.0e0, mean_ndvi + 0.096e0)) AS mean_ndvi,
      R6(least(100.0e0, green_cover + 12.0e0)) AS green_cover, R6(veg_cooling * 1.24e0) AS veg_cooling
    FROM cells WHERE mean_ndvi IS NOT NULL
    UNION ALL SELECT grid_id, tree_count + 120.0e0, R6(least(100.0e0, tree_density + 24.0e0)), NULL, R6(least(100.0e0, green_cover + 12.0e0)), R6(veg_cooling * 1.24e0) FROM cells WHERE mean_ndvi IS NULL""")
def _(d):
    out = SC.perturb(d.cells, SC.intervention("tree_planting", 120))
    return out.select("grid_id", "tree_count", *r6("tree_density", "mean_ndvi", "green_cover", "veg_cooling"))


@query("cool_roof_P36", """
    SELECT grid_id, R6(greatest(0.0e0, impervious_ratio - 2.0e0)) AS impervious_ratio, R6(greatest(0.0e0, building_coverage_pct - 1.2e0)) AS building_coverage_pct,
      R6(greatest(0.0e0, hvi - 0.012e0)) AS hvi, R6(veg_cooling * 1.04e0) AS veg_cooling FROM cells""")
def _(d):
    return SC.perturb(d.cells, SC.intervention("cool_roof", 40)).select("grid_id", *r6("impervious_ratio", "building_coverage_pct", "hvi", "veg_cooling"))


@query("green_corridor_P37", """
    SELECT grid_id, R6(least(100.0e0, green_space_pct + 16.0e0)) AS green_space_pct, R6(green_to_built * 1.3e0) AS green_to_built,
      R6(veg_cooling * 1.3e0) AS veg_cooling, R6(greatest(1.0e0, dist_to_park * 0.8e0)) AS dist_to_park FROM cells""")
def _(d):
    return SC.perturb(d.cells, SC.intervention("green_corridor", 100)).select("grid_id", *r6("green_space_pct", "green_to_built", "veg_cooling", "dist_to_park"))


@query("masked_perturbation_P38", """
    SELECT grid_id, R6(CASE WHEN land_cover_class = 3 THEN least(100.0e0, green_cover + 10.0e0) ELSE green_cover END) AS green_cover,
      CASE WHEN land_cover_class = 3 THEN tree_count + 50.0e0 ELSE tree_count END AS tree_count FROM cells""")
def _(d):
    out = SC.perturb(d.cells, {"green_cover": ("add", 10.0), "tree_count": ("add", 50.0)}, selected=F.col("land_cover_class") == 3)
    return out.select("grid_id", *r6("green_cover"), "tree_count")


@query("landuse_group_P40", """
    SELECT rect_id, CASE trim(landuse) WHEN 'residential' THEN 'Residential' WHEN 'retail' THEN 'Commercial' WHEN 'quarry' THEN 'Industrial' WHEN 'religious' THEN 'Institutional'
      WHEN 'orchard' THEN 'Agriculture' WHEN 'forest' THEN 'Green' WHEN 'grass' THEN 'Green' WHEN 'railway' THEN 'Railway' ELSE 'Other' END AS land_class FROM rects""")
def _(d):
    return d.rects.select("rect_id", fn.landuse_group("landuse").alias("land_class"))


@query("road_filter_P41", """
    SELECT segment_id, trim(highway) IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'tertiary_link') AS major
    FROM segments WHERE trim(highway) NOT IN ('footway', 'path', 'cycleway', 'steps', 'track')""")
def _(d):
    return d.segments.where(fn.is_motor_road("highway")).select("segment_id", fn.is_major_road("highway").alias("major"))


@query("type_guard_P42", """
    SELECT event_id, R6(CASE WHEN isfinite(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'inf' WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE))
      THEN TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'inf' WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) END) AS number FROM observations""")
def _(d):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("Infinity")).when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return d.observations.select("event_id", round_even(fn.to_number(text), 6).alias("number"))


@query("blank_to_null_P43", "SELECT feature_id, nullif(trim(leisure), '') AS leisure FROM osm_tags")
def _(d):
    return d.osm_tags.select("feature_id", fn.blank_to_null("leisure").alias("leisure"))


@query("live_weather_fields_P44", """
    SELECT event_id, R6(value * 3.6e0) AS wind_kmh, CASE WHEN source = 'click' THEN 0.0e0 ELSE value END AS rain_mm, extract(hour FROM observed_at) BETWEEN 6 AND 17 AS is_day FROM observations""")
def _(d):
    at, day = F.col("observed_at"), F.date_trunc("day", "observed_at")
    return d.observations.select(
        "event_id", round_even(fn.wind_kmh("value"), 6).alias("wind_kmh"),
        F.coalesce(F.when(F.col("source") != "click", F.col("value")), F.lit(0.0)).alias("rain_mm"),
        fn.is_daylight(at, day + F.expr("interval 6 hours"), day + F.expr("interval 18 hours")).alias("is_day"))


@query("strict_validation_P45", """
    SELECT grid_id, concat_ws(',', CASE WHEN mean_ndvi IS NULL THEN 'mean_ndvi missing' END, CASE WHEN mean_aqi IS NULL THEN 'mean_aqi missing' END,
      CASE WHEN lc_builtup_pct IS NULL THEN 'lc_builtup_pct missing' END, CASE WHEN land_cover_class = 2 THEN 'ratio not finite' END) AS reasons
    FROM cells WHERE mean_ndvi IS NULL OR mean_aqi IS NULL OR lc_builtup_pct IS NULL OR land_cover_class = 2""")
def _(d):
    rows = d.cells.withColumn("ratio", F.when(F.col("land_cover_class") == 2, F.lit(float("inf"))).otherwise(F.col("hvi")))
    checked = T.validate_rows(rows, ["mean_ndvi", "mean_aqi", "lc_builtup_pct", "ratio"])
    return checked.where(F.size("reasons") > 0).select("grid_id", F.array_join("reasons", ",").alias("reasons"))


@query("fitted_imputation_P46", """
    SELECT grid_id, R6(coalesce(mean_ndvi, (SELECT quantile_cont(mean_ndvi, 0.5) FROM cells))) AS mean_ndvi,
      CASE WHEN land_cover_class = 4 THEN 0.0e0 ELSE land_cover_class - 1.0e0 END AS land_cover_code FROM cells""")
def _(d):
    fitted = T.fit_preprocessor(d.cells.where("land_cover_class <> 4").select("mean_ndvi", F.col("land_cover_class").alias("land_cover_code")), [], ["land_cover_code"])
    (median,) = quantile_columns(d.cells, "mean_ndvi", [0.5])
    rows = d.cells.select("grid_id", F.coalesce(F.col("mean_ndvi"), median).alias("mean_ndvi"), F.col("land_cover_class").alias("land_cover_code"))
    out = T.apply_preprocessor(rows, fitted)
    return out.select("grid_id", *r6("mean_ndvi"), "land_cover_code")


@query("live_override_P47", """
    WITH live AS (SELECT R6(avg(value)) AS aqi, R6(max(value)) AS pm25 FROM observations)
    SELECT grid_id, coalesce((SELECT aqi FROM live), mean_aqi) AS mean_aqi, coalesce((SELECT pm25 FROM live), mean_pm25) AS mean_pm25 FROM cells""")
def _(d):
    live = d.observations.agg(round_even(F.avg("value"), 6).alias("mean_aqi"), round_even(F.max("value"), 6).alias("mean_pm25"))
    return T.override_columns(d.cells, live, ["mean_aqi", "mean_pm25"]).select("grid_id", "mean_aqi", "mean_pm25")


PROVENANCE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{s}', '{st}')" for f, (s, st) in K.FEATURE_PROVENANCE.items()) + ") AS t(feature, source, status)"


@query("feature_provenance_P48", f"""
    WITH p AS ({PROVENANCE_SQL}), l AS (
      SELECT 'mean_ndvi' AS feature, count(mean_ndvi) AS present FROM cells UNION ALL SELECT 'mean_aqi', count(mean_aqi) FROM cells UNION ALL
      SELECT 'dist_to_water', count(dist_to_water) FROM cells UNION ALL SELECT 'hvi', count(hvi) FROM cells UNION ALL SELECT 'max_ndvi', count(max_ndvi) FROM cells)
    SELECT l.feature, coalesce(p.source, 'unknown') AS source, coalesce(p.status, 'UNAVAILABLE') AS status, l.present FROM l LEFT JOIN p ON p.feature = l.feature""")
def _(d):
    return T.feature_provenance(d.cells, ["mean_ndvi", "mean_aqi", "dist_to_water", "hvi", "max_ndvi"])


@query("before_after_P49", """
    SELECT grid_id, R2(mean_lst) AS current_lst, R2(-0.05e0 * green_cover) AS cooling, R2(mean_lst + R2(-0.05e0 * green_cover)) AS after_lst FROM cells""")
def _(d):
    cooling = round_even(F.lit(-0.05) * F.col("green_cover"), 2)
    return d.cells.select("grid_id", round_even("mean_lst", 2).alias("current_lst"), cooling.alias("cooling"), round_even(F.col("mean_lst") + cooling, 2).alias("after_lst"))


@query("change_class_P50", """
    SELECT grid_id, CASE WHEN predicted_lst - target_lst > 0.5 THEN 'warming' WHEN predicted_lst - target_lst < -0.5 THEN 'cooling' ELSE 'unchanged' END AS change FROM close_predictions""")
def _(d):
    from thermogrid.plans.temporal import change_class

    return d.close_predictions.select("grid_id", change_class(F.col("predicted_lst") - F.col("target_lst")).alias("change"))


@query("aspect_direction_P51", """
    SELECT row_id, col_id, CASE WHEN angle = -1 THEN 'Flat' ELSE ['N','NE','E','SE','S','SW','W','NW'][CAST(floor(((angle + 22.5e0) % 360.0e0) / 45.0e0) AS INT) + 1] END AS direction FROM pixels""")
def _(d):
    return d.pixels.select("row_id", "col_id", aspect_direction("angle").alias("direction"))


@query("clean_layer_P52", "SELECT rect_id, CASE WHEN geom_type = 'Polygon' THEN 5 ELSE 4 END AS vertices FROM rects WHERE height_m IS NOT NULL")
def _(d):
    from thermogrid.sources.readers import clean_layer

    pt = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    ring = F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1"))
    raw = d.rects.select("rect_id", "geom_type", F.when(F.col("height_m").isNull() & (F.col("rect_id") % 2 == 0), F.slice(ring, 1, 0))
                         .when(F.col("height_m").isNotNull(), ring).alias("coords"))
    return clean_layer(raw).select("rect_id", F.size("coords").alias("vertices"))


@query("training_projection_P53", "SELECT grid_id, R6(lst_c) AS lst_c FROM cell_lst_dates WHERE lst_c IS NOT NULL")
def _(d):
    from thermogrid.plans.temporal import training_rows

    return training_rows(d.cell_lst_dates, "lst_c", ["date", "scene_id", "cloud_cover", "scene_key"]).select("grid_id", *r6("lst_c"))
