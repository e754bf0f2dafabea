"""What-if scenarios: perturb, score, compare. Scenarios are data; a run is one narrow pass over the cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermogrid import constants as K
from thermogrid.functions import clip

Perturbations = dict[str, tuple[str, float]]
Scorer = Callable[[DataFrame], DataFrame]

LINEAR_FEATURES = {"green_cover": -0.05, "mean_ndvi": -2.0, "impervious_ratio": 0.01}


# --- perturbation sets --------------------------------------------------------------------------------


def intervention(name: str, strength: float) -> Perturbations:
    """The steps of a named intervention at a strength in its own measure (trees, percent of roofs, metres of width).

    Steps grow in proportion to the strength, factors by their distance from 1; no factor falls below 0.
    """
    spec = K.INTERVENTIONS[name]
    low, high = spec["range"]
    if strength < low or (high is not None and strength > high):
        raise ValueError(f"{name}: strength {strength} is out of range")
    units = strength / spec["unit"]
    return {f: (kind, units * v if kind == "add" else max(0.0, 1.0 + units * (v - 1.0))) for f, (kind, v) in spec["steps"].items()}


def ratio_scaled(perturbations: Perturbations) -> Perturbations:
    """The standard sets add percentage points to the impervious ratio, which is a 0..1 share, and so drive it
    to 0. This variant divides those steps by 100."""
    kind, value = perturbations.get("impervious_ratio", ("mul", 1.0))
    return {**perturbations, "impervious_ratio": (kind, value / 100.0)} if kind == "add" else dict(perturbations)


def all_scenarios() -> dict[str, Perturbations]:
    """The seven standard scenarios and the three interventions at their default strength."""
    return {
        **K.SCENARIOS, "tree_planting": intervention("tree_planting", 100), "cool_roofs_30pct": intervention("cool_roof", 30),
        "green_corridor": intervention("green_corridor", 50),
    }


def scenario_table(spark: SparkSession, scenarios: dict[str, Perturbations] | None = None) -> DataFrame:
    rows = [(s, f, k, float(v)) for s, m in (scenarios or K.SCENARIOS).items() for f, (k, v) in m.items()]
    return spark.createDataFrame(rows, "scenario string, feature string, kind string, value double")


# --- perturbation ------------------------------------------------------------------------------------


KINDS = ("add", "mul", "min", "max")


def changed(feature: str, kind: Column, amount: Column) -> Column:
    """One feature after a change given as columns, held within the feature's bounds; a missing value stays missing."""
    v = F.col(feature)
    new = (
        F.when(kind == "add", v + amount).when(kind == "mul", v * amount)
        .when(kind == "min", F.when(v > amount, amount).otherwise(v)).when(kind == "max", F.when(v < amount, amount).otherwise(v))
    )
    return clip(new, *K.FEATURE_BOUNDS.get(feature, (None, None)))


def perturbed(feature: str, kind: str, value: float) -> Column:
    """The same for a change known beforehand: constant folding leaves the one branch."""
    if kind not in KINDS:
        raise ValueError(f"perturbations are {', '.join(KINDS)}, not {kind}")
    return changed(feature, F.lit(kind), F.lit(float(value)))


def perturb(df: DataFrame, perturbations: Perturbations, selected: Column | None = None) -> DataFrame:
    """Change features, everywhere or in the selected cells only. Features the table lacks are skipped."""
    changed = {}
    for feature, (kind, value) in perturbations.items():
        new = perturbed(feature, kind, value)
        if feature in df.columns:
            changed[feature] = new if selected is None else F.when(selected, new).otherwise(F.col(feature))
    return df.withColumns(changed)


def expand(df: DataFrame, scenarios: dict[str, Perturbations]) -> DataFrame:
    """Every cell under every scenario, without a join: the scenario names grow from each row, and each
    feature picks its change by name."""
    spread = df.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    touched = [c for c in df.columns if any(c in p for p in scenarios.values())]

    def pick(feature: str) -> Column:
        out = F.when(F.lit(False), F.col(feature))
        for name, changes in scenarios.items():
            if feature in changes:
                out = out.when(F.col("scenario") == name, perturbed(feature, *changes[feature]))
        return out.otherwise(F.col(feature))

    return spread.withColumns({f: pick(f) for f in touched})


# --- scorers -----------------------------------------------------------------------------------------


def linear_score(weights: dict[str, float] | None = None, base: float = 35.0) -> Column:
    """Closed-form scorer: a missing feature counts as 0."""
    total = F.lit(base)
    for feature, w in (weights or LINEAR_FEATURES).items():
        total = total + F.lit(w) * F.coalesce(F.col(feature), F.lit(0.0))
    return total


def linear_scorer(weights: dict[str, float] | None = None, base: float = 35.0) -> Scorer:
    return lambda df: df.withColumn("predicted_lst", linear_score(weights, base))


def model_scorer(model) -> Scorer:
    """A fitted Spark ML model whose prediction column is 'prediction'."""
    return lambda df: model.transform(df).withColumnRenamed("prediction", "predicted_lst").drop("features")


def pandas_scorer(load: Callable[[], Callable[[pd.DataFrame], object]], features: list[str]) -> Scorer:
    """Any Python predictor. `load` runs once per task; batches arrive by Arrow."""

    def score(df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            fn = load()
            for batch in batches:
                yield pd.Series(fn(batch), dtype="float64")

        return df.withColumn("predicted_lst", predict(F.struct(*features)))

    return score


# --- runs --------------------------------------------------------------------------------------------


def run_scenarios(cells: DataFrame, scorer: Scorer, scenarios: dict[str, Perturbations]) -> DataFrame:
    """(scenario, grid_id, baseline_lst, scenario_lst, delta_lst) for every cell and scenario."""
    baseline = scorer(cells).withColumnRenamed("predicted_lst", "baseline_lst")
    scored = scorer(expand(baseline, scenarios)).withColumnRenamed("predicted_lst", "scenario_lst")
    return scored.select("scenario", "grid_id", "baseline_lst", "scenario_lst", (F.col("scenario_lst") - F.col("baseline_lst")).alias("delta_lst"))


def run_area_scenario(cells: DataFrame, scorer: Scorer, perturbations: Perturbations, selected: Column) -> DataFrame:
    """Baseline and scenario per cell when only the selected cells change."""
    baseline = scorer(cells.withColumn("selected", selected)).withColumnRenamed("predicted_lst", "baseline_lst")
    scored = scorer(perturb(baseline, perturbations, F.col("selected"))).withColumnRenamed("predicted_lst", "scenario_lst")
    return scored.select("grid_id", "selected", "baseline_lst", "scenario_lst", (F.col("scenario_lst") - F.col("baseline_lst")).alias("delta_lst"))


def summarise(results: DataFrame, *by: str) -> DataFrame:
    delta = F.col("delta_lst")
    return results.groupBy(*by).agg(
        F.avg("baseline_lst").alias("baseline_lst"), F.avg("scenario_lst").alias("mean_predicted_lst"), F.avg(delta).alias("mean_delta_lst"),
        F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"),
        (F.count_if(delta < 0) / F.count(delta) * F.lit(100.0)).alias("pct_cells_cooler"), F.count(F.lit(1)).alias("n_cells"),
    )


def validate_area(results: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Did anything change outside the selected area?"""
    changed = F.abs(F.col("scenario_lst") - F.col("baseline_lst")) >= tolerance
    inside = F.col("selected")
    counts = results.agg(
        F.count_if(inside).alias("affected_cells"), F.count_if(changed).alias("changed_cells"), F.count_if(~changed).alias("unchanged_cells"),
        F.count_if(~inside).alias("outside_total"), F.count_if(~inside & ~changed).alias("outside_unchanged"),
        F.count_if(inside & changed).alias("inside_changed"), F.count_if(inside & ~changed).alias("inside_unchanged"),
    )
    return counts.withColumn("validation_passed", F.col("outside_total") == F.col("outside_unchanged"))


# --- impact per cell -------------------------------------------------------------------------------------


def cell_impact(results: DataFrame, worth: float = 0.1) -> DataFrame:
    """Per cell over all scenarios: the strongest cooling and who gives it, the mean change, and how many scenarios cool by `worth` or more.

    An aggregate with partial sums: a cell's scenarios are neighbours where they were expanded, so most of it happens before the shuffle.
    """
    delta = F.col("delta_lst")
    return results.groupBy("grid_id").agg(
        F.min_by("scenario", F.struct(delta, F.col("scenario"))).alias("best_scenario"), (-F.min(delta)).alias("best_cooling"),
        F.avg(delta).alias("mean_delta_lst"), F.count_if(delta <= -worth).alias("worthwhile"),
    )


def impact_summary(impact: DataFrame) -> DataFrame:
    """One row: cells that some scenario cools, their mean and greatest cooling, and those with a choice of scenarios."""
    cooled = F.col("best_cooling") > 0
    return impact.agg(
        F.count_if(cooled).alias("affected_cells"), F.avg(F.when(cooled, F.col("best_cooling"))).alias("mean_cooling"),
        F.max("best_cooling").alias("max_cooling"), F.count_if(F.col("worthwhile") > 1).alias("cells_with_choice"),
    )
