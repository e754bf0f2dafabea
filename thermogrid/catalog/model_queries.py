"""M1-M6: model work. Results of trees depend on the library's generator, so these have no SQL twin; linear models have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid.catalog.registry import query
from thermogrid.catalog.window_queries import draw_sql
from thermogrid.functions import round_even
from thermogrid.plans import models as MD

FEATURES = ["green_cover", "mean_ndvi", "impervious_ratio", "building_coverage_pct", "tree_count", "dist_to_park", "hvi"]


def learnable(d):
    """Cells with a target that follows the features plus a small disturbance."""
    c = d.cells.withColumn("mean_ndvi", F.coalesce("mean_ndvi", F.lit(0.3)))
    y = 35.0 - 0.05 * F.col("green_cover") - 2.0 * F.col("mean_ndvi") + 4.0 * F.col("impervious_ratio") + (F.col("grid_id") * 17 % 100) / 200.0
    return c.select("grid_id", *FEATURES, y.alias("target_lst"))


def rounded(df, *keep):
    return df.select(*keep, *[round_even(c, 4).alias(c) for c in ("rmse", "mae", "r2", "mape")])


@query("baseline_importance_M1")
def _(d):
    return MD.baseline_importance(learnable(d), FEATURES, "target_lst", trees=20, depth=6)


@query("model_leaderboard_M2")
def _(d):
    split = MD.hash_split(learnable(d), "grid_id")
    models = {"RandomForest": MD.random_forest("target_lst", 15, 6), "GradientBoosting": MD.boosted_trees("target_lst", 15, 4), "Linear": MD.linear("target_lst")}
    return rounded(MD.leaderboard(split.where("not is_test"), split.where("is_test"), FEATURES, "target_lst", models), "rank", "model")


def linear_sql(training: str, keys: str) -> str:
    """Weights w(k, b, centre, spread, target_centre, target_spread) of a linear model per key by elimination; `training`: rows t with k."""
    n = len(FEATURES)
    entry = lambda i, j: f"{1 + 1e-6!r}e0" if i == j else f"corr({FEATURES[i]}, {FEATURES[j]})"
    matrix = ", ".join("[" + ", ".join([*(entry(i, j) for j in range(n)), f"corr({FEATURES[i]}, target_lst)"]) + "]" for i in range(n))
    return f"""learnable AS (SELECT grid_id, {", ".join("coalesce(mean_ndvi, 0.3e0) AS mean_ndvi" if f == "mean_ndvi" else f for f in FEATURES)},
      35.0e0 - 0.05e0 * green_cover - 2.0e0 * coalesce(mean_ndvi, 0.3e0) + 4.0e0 * impervious_ratio + (grid_id * 17 % 100) / 200.0e0 AS target_lst FROM cells),
    folded AS (SELECT *, {draw_sql('grid_id', 42)} % 1000000 < 200000 AS is_test, CAST({draw_sql('grid_id', 43)} % 5 AS INT) AS fold FROM learnable),
    g AS (SELECT {keys} AS k, [{matrix}] AS m, [{", ".join(f"avg({f})" for f in FEATURES)}] AS centre, [{", ".join(f"stddev_pop({f})" for f in FEATURES)}] AS spread,
      avg(target_lst) AS tc, stddev_pop(target_lst) AS ts FROM {training} GROUP BY 1),
    s AS (SELECT k, 1 AS step, m FROM g UNION ALL SELECT k, step + 1, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}),
      lambda j: CASE WHEN i = step THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][step] / m[step][step] * m[step][j] END)) FROM s WHERE step <= {n}),
    w AS (SELECT g.k, list_transform(range(1, {n + 1}), lambda i: s.m[i][{n + 1}] * ts / spread[i]) AS b, centre, tc FROM s JOIN g ON g.k = s.k WHERE step = {n + 1})"""


_PREDICTED = "tc" + "".join(f" + b[{i}] * ({f} - centre[{i}])" for i, f in enumerate(FEATURES, 1))


@query("grid_prediction_M3", "WITH RECURSIVE " + linear_sql("folded WHERE NOT is_test", "0") + f"""
    SELECT grid_id, R3({_PREDICTED}) AS predicted_lst FROM folded, w""")
def _(d):
    rows = learnable(d)
    model = MD.linear_fit(MD.hash_split(rows, "grid_id").where("not is_test"), FEATURES, "target_lst")
    return rows.select("grid_id", round_even(model.predict(), 3).alias("predicted_lst"))


@query("cross_validation_M4", "WITH RECURSIVE " + linear_sql("folded JOIN (SELECT unnest(range(5)) AS held) h ON fold <> held", "held") + f""",
    e AS (SELECT fold, target_lst AS t, {_PREDICTED} - target_lst AS d FROM folded JOIN w ON k = fold)
    SELECT fold, R4(sqrt(avg(d * d))) AS rmse, R4(avg(abs(d))) AS mae, R4(1 - sum(d * d) / (var_pop(t) * count(*))) AS r2, R4(avg(abs(d) / abs(t)) * 100) AS mape FROM e GROUP BY fold""")
def _(d):
    folded = MD.hash_folds(learnable(d), "grid_id", 5)
    return rounded(MD.cross_validate_linear(folded, FEATURES, "target_lst"), "fold")


@query("parameter_search_M5")
def _(d):
    marked = MD.early_stopping_slice(learnable(d), "grid_id")
    return rounded(MD.search_parameters(marked, FEATURES, "target_lst", {"depth": [3, 5], "step": [0.1, 0.3]}, rounds=10), "depth", "step")


@query("temporal_model_M6")
def _(d):
    rows = d.cell_lst_dates.where(F.col("lst_c").isNotNull()).select("grid_id", "date", "lst_c")
    joined = rows.join(d.cells.select("grid_id", "mean_lst", "green_cover", "impervious_ratio"), "grid_id").withColumn("month", F.month("date"))
    _, metrics = MD.temporal_model(joined, ["mean_lst", "green_cover", "impervious_ratio", "month"], "lst_c", "date", rounds=15, depth=5)
    return rounded(metrics, "split")
