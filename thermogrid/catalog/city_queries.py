"""Scenario runs, rankings, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid import constants as K
from thermogrid.catalog.join_queries import CITY_BOX, EXPLAIN_FEATURES, EXPLAIN_SQL, OUTLINE, importance_table, pip_sql
from thermogrid.catalog.aggregate_queries import _IMP, contributions, sel
from thermogrid.catalog.registry import query
from thermogrid.catalog.window_queries import draw_sql
from thermogrid.functions import round_even
from thermogrid.operators import spatial as S
from thermogrid.operators.keyed import top_n
from thermogrid.plans import city as C, scenario as SC, temporal as TP


def r6(*names):
    return [round_even(n, 6).alias(n) for n in names]


def score_sql(f: dict[str, str] | None = None) -> str:
    f = {**{c: c for c in SC.LINEAR_FEATURES}, **(f or {})}
    return "(35.0e0 + " + " + ".join(f"({w}e0) * coalesce({f[c]}, 0.0e0)" for c, w in SC.LINEAR_FEATURES.items()) + ")"


def change_sql(feature: str, kind: str, value: float) -> str:
    raw = {"add": f"({feature} + ({value!r}e0))", "mul": f"({feature} * {value!r}e0)"}[kind]
    low, high = K.FEATURE_BOUNDS.get(feature, (None, None))
    out = raw if low is None else f"greatest({low!r}e0, {raw})"
    out = out if high is None else f"least({high!r}e0, {out})"
    return f"CASE WHEN {feature} IS NOT NULL THEN {out} END"


def results_sql(scenarios: dict) -> str:
    parts = []
    for name, p in scenarios.items():
        changed = {f: change_sql(f, *kv) for f, kv in p.items() if f in SC.LINEAR_FEATURES}
        parts.append(f"SELECT '{name}' AS scenario, grid_id, {score_sql()} AS baseline_lst, {score_sql(changed)} AS scenario_lst FROM cells")
    return f"WITH r0 AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, scenario_lst - baseline_lst AS delta_lst FROM r0)\n"


RESULTS = results_sql(K.SCENARIOS)
ALL_RESULTS = results_sql(SC.all_scenarios())


def results(d, scenarios=None):
    return SC.run_scenarios(d.cells, SC.linear_scorer(), scenarios or K.SCENARIOS)


_SUMMARY = """R6(avg(baseline_lst)) AS baseline_lst, R6(avg(scenario_lst)) AS mean_predicted_lst, R6(avg(delta_lst)) AS mean_delta_lst, R6(min(delta_lst)) AS min_delta,
      R6(max(delta_lst)) AS max_delta, R6(count(*) FILTER (delta_lst < 0) * 100.0e0 / count(*)) AS pct_cells_cooler, count(*) AS n_cells"""


@query("pluggable_scorer_X1", f"SELECT grid_id, R6({score_sql()}) AS by_column, R6({score_sql()}) AS by_python FROM cells")
def _(d):
    names = list(SC.LINEAR_FEATURES)

    def load():
        weights = dict(SC.LINEAR_FEATURES)
        return lambda batch: 35.0 + sum(w * batch[c].fillna(0.0) for c, w in weights.items())

    a = SC.linear_scorer()(d.cells).withColumnRenamed("predicted_lst", "by_column")
    b = SC.pandas_scorer(load, names)(a).withColumnRenamed("predicted_lst", "by_python")
    return b.select("grid_id", *r6("by_column", "by_python"))


@query("scenario_cells_M7", RESULTS + "SELECT scenario, grid_id, R6(baseline_lst) AS baseline_lst, R6(scenario_lst) AS scenario_lst, R6(delta_lst) AS delta_lst FROM r")
def _(d):
    return results(d).select("scenario", "grid_id", *r6("baseline_lst", "scenario_lst", "delta_lst"))


AREA = f"""WITH r AS (SELECT grid_id, {pip_sql('lon', 'lat')} AS selected, {score_sql()} AS baseline_lst,
    CASE WHEN {pip_sql('lon', 'lat')} THEN {score_sql({f: change_sql(f, *kv) for f, kv in K.SCENARIOS['increase_green_20'].items() if f in SC.LINEAR_FEATURES})} ELSE {score_sql()} END AS scenario_lst FROM cells)
"""


def area_run(d):
    marked = S.mark_in_polygon(d.cells, "lon", "lat", OUTLINE, "in_outline")
    return SC.run_area_scenario(marked, SC.linear_scorer(), K.SCENARIOS["increase_green_20"], F.col("in_outline"))


@query("area_scenario_M8", AREA + "SELECT grid_id, selected, R6(baseline_lst) AS baseline_lst, R6(scenario_lst) AS scenario_lst FROM r")
def _(d):
    return area_run(d).select("grid_id", "selected", *r6("baseline_lst", "scenario_lst"))


@query("area_validation_A35", AREA + """
    SELECT count(*) FILTER (selected) AS affected_cells, count(*) FILTER (abs(scenario_lst - baseline_lst) >= 1e-5) AS changed_cells, count(*) FILTER (abs(scenario_lst - baseline_lst) < 1e-5) AS unchanged_cells,
      count(*) FILTER (NOT selected) AS outside_total, count(*) FILTER (NOT selected AND abs(scenario_lst - baseline_lst) < 1e-5) AS outside_unchanged,
      count(*) FILTER (selected AND abs(scenario_lst - baseline_lst) >= 1e-5) AS inside_changed, count(*) FILTER (selected AND abs(scenario_lst - baseline_lst) < 1e-5) AS inside_unchanged, true AS validation_passed FROM r""")
def _(d):
    return SC.validate_area(area_run(d))


@query("run_all_scenarios_M9", ALL_RESULTS + f"SELECT scenario, {_SUMMARY} FROM r GROUP BY scenario ORDER BY avg(delta_lst)")
def _(d):
    return sel(SC.summarise(results(d, SC.all_scenarios()), "scenario").orderBy("mean_delta_lst", "scenario"))


@query("scenario_summary_A34", RESULTS + f"SELECT scenario, {_SUMMARY} FROM r GROUP BY scenario")
def _(d):
    return sel(SC.summarise(results(d), "scenario"))


@query("cooling_potential_A36", RESULTS + "SELECT grid_id, R2(min(delta_lst)) AS max_cooling_c FROM r GROUP BY grid_id")
def _(d):
    return C.cooling_potential(results(d)).select("grid_id", "max_cooling_c")


@query("best_scenario_per_cell_A36b", RESULTS + """
    , t AS (SELECT grid_id, scenario, row_number() OVER (PARTITION BY grid_id ORDER BY delta_lst, scenario) AS rn FROM r) SELECT scenario AS best_scenario, count(*) AS cells FROM t WHERE rn = 1 GROUP BY scenario""")
def _(d):
    return C.cooling_potential(results(d)).groupBy("best_scenario").agg(F.count(F.lit(1)).alias("cells"))


@query("city_summary_A37", RESULTS + f"""
    , p AS (SELECT *, {score_sql()} AS predicted_lst FROM cells), b AS (SELECT scenario, avg(delta_lst) AS m FROM r GROUP BY scenario ORDER BY m, scenario LIMIT 1)
    SELECT R4(avg(predicted_lst)) AS current_heat, R4(avg(mean_aqi)) AS aqi, R4(avg(mean_ndvi)) AS ndvi, R4(avg(building_coverage_pct)) AS urban_density,
      (SELECT grid_id FROM p ORDER BY R2(predicted_lst) DESC, grid_id LIMIT 1) AS hottest_cell, R4(max(predicted_lst)) AS hottest_lst, (SELECT scenario FROM b) AS best_scenario, (SELECT R4(m) FROM b) AS best_mean_delta FROM p""")
def _(d):
    scored = SC.linear_scorer()(d.cells)
    return sel(C.city_summary(scored, SC.summarise(results(d), "scenario")), digits=4)


@query("top_cells_per_scenario_W5", RESULTS + """
    SELECT scenario, grid_id, "rank" FROM (SELECT scenario, grid_id, row_number() OVER (PARTITION BY scenario ORDER BY R6(delta_lst), grid_id) AS "rank" FROM r) q WHERE "rank" <= 5""")
def _(d):
    r = results(d).withColumn("delta_lst", round_even("delta_lst", 6))
    return C.top_cells_per_scenario(r, 5).select("scenario", "grid_id", "rank")


@query("hottest_cells_L1", f"SELECT grid_id, R2({score_sql()}) AS predicted_lst FROM cells ORDER BY 2 DESC, grid_id LIMIT 50")
def _(d):
    return C.hotspots(SC.linear_scorer()(d.cells), "predicted_lst", 50).select("grid_id", "predicted_lst")


@query("strongest_interventions_L2", RESULTS + """
    , t AS (SELECT scenario, grid_id, delta_lst, row_number() OVER (PARTITION BY scenario ORDER BY R6(delta_lst), grid_id) AS rn FROM r)
    SELECT t.scenario, t.grid_id, R2(c.mean_lst) AS current_lst, R2(R6(delta_lst)) AS cooling, R2(c.mean_lst + R2(R6(delta_lst))) AS after_lst FROM t JOIN cells c ON c.grid_id = t.grid_id WHERE rn <= 5
    ORDER BY cooling, t.scenario, t.grid_id LIMIT 35""")
def _(d):
    r = results(d).withColumn("delta_lst", round_even("delta_lst", 6))
    out = C.interventions(r, d.cells, 5).orderBy("cooling", "scenario", "grid_id").limit(35)
    return out.select("scenario", "grid_id", round_even("current_lst", 2).alias("current_lst"), "cooling", "after_lst")


@query("explanation_factors_L3", EXPLAIN_SQL + """
    SELECT grid_id, feature, "rank" FROM (SELECT grid_id, feature, row_number() OVER (PARTITION BY grid_id ORDER BY R6(importance) DESC, feature) AS "rank" FROM factors) q WHERE "rank" <= 8""")
def _(d):
    e = C.explain_cells(d.cells, importance_table(d), EXPLAIN_FEATURES)
    return top_n(e, ["grid_id"], [F.desc(round_even("importance", 6)), F.col("feature")], 8).select("grid_id", "feature", "rank")


IMPACT_SQL = RESULTS + """, i AS (SELECT grid_id, -min(delta_lst) AS best_cooling, avg(delta_lst) AS mean_delta_lst,
      count(*) FILTER (delta_lst <= -0.1e0) AS worthwhile FROM r GROUP BY grid_id)
"""


@query("cell_impact_P39", IMPACT_SQL + "SELECT grid_id, R6(best_cooling) AS best_cooling, R6(mean_delta_lst) AS mean_delta_lst, worthwhile FROM i")
def _(d):
    return SC.cell_impact(results(d)).select("grid_id", *r6("best_cooling", "mean_delta_lst"), "worthwhile")


@query("impact_summary_A49", IMPACT_SQL + """
    SELECT count(*) FILTER (best_cooling > 0) AS affected_cells, R6(avg(CASE WHEN best_cooling > 0 THEN best_cooling END)) AS mean_cooling, R6(max(best_cooling)) AS max_cooling,
      count(*) FILTER (worthwhile > 1) AS cells_with_choice FROM i""")
def _(d):
    return SC.impact_summary(SC.cell_impact(results(d))).select("affected_cells", *r6("mean_cooling", "max_cooling"), "cells_with_choice")


@query("priority_cells_L4", IMPACT_SQL + "SELECT grid_id, R6(best_cooling) AS best_cooling FROM i ORDER BY R6(best_cooling) DESC, grid_id LIMIT 8")
def _(d):
    cooling = SC.cell_impact(results(d)).select("grid_id", *r6("best_cooling"))
    return cooling.orderBy(F.desc("best_cooling"), "grid_id").limit(8)


@query("rank_scenarios_L5", RESULTS + "SELECT scenario, R6(avg(delta_lst)) AS mean_delta_lst, row_number() OVER (ORDER BY R6(avg(delta_lst)), scenario) AS \"rank\" FROM r GROUP BY scenario")
def _(d):
    from pyspark.sql import Window as W

    s = SC.summarise(results(d), "scenario").select("scenario", *r6("mean_delta_lst"))  # one row per scenario
    return s.withColumn("rank", F.row_number().over(W.orderBy("mean_delta_lst", "scenario")))


@query("latest_observation_L6", "SELECT date, scene_id, cloud_cover FROM scenes ORDER BY date DESC, scene_id DESC LIMIT 1")
def _(d):
    return TP.latest_observation(d.scenes).select("date", "scene_id", "cloud_cover")


@query("newest_clean_scene_L7", """
    SELECT date, scene_id FROM scenes WHERE cloud_cover < 20 AND xmin - 1e-7 <= 85.72e0 AND ymin - 1e-7 <= 20.08e0 AND xmax + 1e-7 >= 86.0e0 AND ymax + 1e-7 >= 20.5e0 ORDER BY date DESC, scene_id LIMIT 1""")
def _(d):
    return TP.newest_clean_scene(d.scenes, CITY_BOX, 20.0).select("date", "scene_id")


@query("first_scenes_L8", "SELECT date, scene_id FROM scenes ORDER BY date, scene_id LIMIT 10")
def _(d):
    return d.scenes.orderBy("date", "scene_id").limit(10).select("date", "scene_id")


@query("fixed_sample_L9", f"SELECT grid_id, R6(mean_lst) AS mean_lst FROM cells ORDER BY {draw_sql('grid_id', 42)}, grid_id LIMIT 300")
def _(d):
    from thermogrid.plans.models import fixed_sample

    return fixed_sample(d.cells, "grid_id", 300).select("grid_id", *r6("mean_lst"))


@query("date_slice_L10", "SELECT grid_id, scene_key, date FROM cell_lst_dates WHERE date BETWEEN DATE '2024-03-01' AND DATE '2024-08-31'")
def _(d):
    return d.cell_lst_dates.where(F.col("date").between("2024-03-01", "2024-08-31")).select("grid_id", "scene_key", "date")


@query("strongest_cooling_L11", RESULTS + "SELECT grid_id, R3(delta_lst) AS delta_lst FROM r WHERE scenario = 'increase_trees' ORDER BY R6(delta_lst), grid_id LIMIT 5")
def _(d):
    r = results(d, {"increase_trees": K.SCENARIOS["increase_trees"]})
    return r.orderBy(round_even("delta_lst", 6), "grid_id").limit(5).select("grid_id", round_even("delta_lst", 3).alias("delta_lst"))


@query("top_features_L12", _IMP + "SELECT feature, R6(v) AS mean_abs FROM i ORDER BY v DESC LIMIT 10")
def _(d):
    imp = C.importance_share(contributions(d), ["grid_id"], ["green_cover", "mean_ndvi", "impervious_ratio"])
    return imp.orderBy(F.desc("mean_abs"), "feature").limit(10).select("feature", *r6("mean_abs"))


@query("hottest_cells_with_features", f"""
    SELECT grid_id, R2({score_sql()}) AS predicted_lst, CASE WHEN {score_sql()} < 20 THEN 'Very Cool' WHEN {score_sql()} < 25 THEN 'Cool' WHEN {score_sql()} < 30 THEN 'Moderate' WHEN {score_sql()} < 35 THEN 'Warm'
      WHEN {score_sql()} < 40 THEN 'Hot' ELSE 'Very Hot' END AS heat, R6(mean_ndvi) AS mean_ndvi, R6(green_cover) AS green_cover FROM cells ORDER BY 2 DESC, grid_id LIMIT 10""")
def hottest_cells(d):
    """The flagship: score every cell, label it, keep the ten hottest, bring their features along."""
    hot = C.hotspots(SC.linear_scorer()(d.cells).select("grid_id", "predicted_lst"), "predicted_lst", 10)
    return C.enrich(hot, d.cells, ["mean_ndvi", "green_cover"]).select("grid_id", "predicted_lst", "heat", *r6("mean_ndvi", "green_cover"))
