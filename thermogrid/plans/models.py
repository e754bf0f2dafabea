"""Model work on Spark ML: splits, folds, leaderboards, search, importance."""

from __future__ import annotations

import contextlib
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thermogrid.operators.gram import cross_moments
from thermogrid.operators.keyed import union_all
from thermogrid.operators.metrics import regression_metrics
from thermogrid.operators.selection import cut_of_order
from thermogrid.operators.series import split_by_date


def split_leakage(cells: DataFrame, id_column: str = "grid_id", test: str = "is_test") -> DataFrame:
    """How many test cells have a training cell next to them in id order."""
    train = cells.where(~F.col(test)).select(F.explode(F.array(F.col(id_column) - 1, F.col(id_column) + 1)).alias(id_column))
    tested = cells.where(F.col(test)).select(id_column)
    close = tested.join(train, id_column, "left_semi").agg(F.count(F.lit(1)).alias("adjacent"))
    return tested.agg(F.count(F.lit(1)).alias("test_cells")).withColumn("adjacent", close.scalar()).withColumn(
        "adjacent_pct", F.col("adjacent") / F.col("test_cells") * F.lit(100.0))


def draw(df: DataFrame, id_column: str, seed: int) -> Column:
    """A number below 2^31 - 1 that depends on a row's id and the seed only.

    Whole ids go through plain arithmetic that any engine can repeat; other ids are hashed to a whole number first.
    """
    whole = dict(df.dtypes)[id_column] in ("tinyint", "smallint", "int", "bigint")
    x = F.pmod(F.col(id_column).cast("long") if whole else F.xxhash64(id_column), F.lit(1_000_000_007))
    return ((x * 1_000_003 + seed * 7919) % 998_244_353 * 48_271 + 12_345) % 2_147_483_647


def hash_split(df: DataFrame, id_column: str, test_share: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Random but reproducible split: a row's side depends on its id only, not on partitioning."""
    return df.withColumn(name, draw(df, id_column, seed) % 1_000_000 < int(test_share * 1_000_000))


def hash_folds(df: DataFrame, id_column: str, folds: int, seed: int = 43) -> DataFrame:
    return df.withColumn("fold", (draw(df, id_column, seed) % folds).cast("int"))


def fixed_sample(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all with an id), the same ones every time, however large n is: rows of the smallest draws, ties by id.

    Where an id repeats and only some of its rows fit, these are the first in the order of their columns.
    """
    key = draw(df, id_column, seed)
    cut = cut_of_order(df, key, 31, id_column, lambda _: n)
    if cut is None:
        return df.limit(0)
    if cut.left == cut.held:
        return df.where(cut.before(key, id_column) | cut.last(key, id_column))
    return df.where(cut.before(key, id_column)).unionByName(df.where(cut.last(key, id_column)).orderBy(*df.columns).limit(cut.left))


def early_stopping_slice(df: DataFrame, id_column: str, share: float = 0.10, minimum: int = 500, seed: int = 44) -> DataFrame:
    """Mark max(minimum, share) rows for early stopping, but no more than half, in random but reproducible order.

    Whether a row is marked follows from its id alone, so repeats of the last id taken are all marked; rows without an id are not.
    """
    number = draw(df, id_column, seed)
    key = (number % 4096) * 2**19 + F.shiftright(number, 12)
    cut = cut_of_order(df, key, 31, id_column, lambda rows: min(max(minimum, int(rows * share)), rows // 2))
    marked = F.lit(False) if cut is None else F.coalesce(cut.before(key, id_column) | cut.last(key, id_column), F.lit(False))
    return df.withColumn("validation", marked)


def rank_models(metrics: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """1..n by RMSE; the table has one row per model."""
    w = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("rmse", name)
    return metrics.withColumn("rank", F.row_number().over(w))


# --- Spark ML ----------------------------------------------------------------------------------------


def _with_features(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"), estimator])


def random_forest(target: str, trees: int = 300, depth: int = 12, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)


def boosted_trees(target: str, rounds: int = 100, depth: int = 6, step: float = 0.1, seed: int = 42, validation: str | None = None) -> GBTRegressor:
    gbt = GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.9, seed=seed)
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def linear(target: str) -> LinearRegression:
    return LinearRegression(labelCol=target, regParam=1e-6)


@dataclass(frozen=True)
class LinearFit:
    """Weights of a linear model, as a Spark column over its features."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self) -> Column:
        terms = [F.lit(w) * F.col(f).cast("double") for f, w in zip(self.features, self.weights)]
        return sum(terms, F.lit(self.intercept))


def _solved(features: Sequence[str], sums: np.ndarray, means: np.ndarray, ridge: float) -> LinearFit:
    """Least squares with a small ridge on standardised features, from n, sums and cross products about `means` (target last)."""
    n, linear, cross = sums[0, 0, 0], np.diag(sums[1]), sums[2]
    if n < 2:
        return LinearFit(tuple(features), (0.0,) * len(features), float("nan") if n < 1 else float(means[-1] + linear[-1] / n))
    shared = (cross - np.outer(linear, linear) / n) / n
    scale = np.sqrt(np.maximum(np.diag(shared), 0.0))
    varies = scale > 1e-12 * np.abs(means)
    scale = np.where(varies, scale, 1.0)
    alike = np.where(np.outer(varies, varies), shared / np.outer(scale, scale), 0.0)
    weights = np.linalg.solve(alike[:-1, :-1] + np.diag(np.where(varies[:-1], ridge, 1.0)), alike[:-1, -1]) * scale[-1] / scale[:-1]
    centre = means + linear / n
    return LinearFit(tuple(features), tuple(float(w) for w in weights), float(centre[-1] - weights @ centre[:-1]))


def _product_sums(df: DataFrame, features: Sequence[str], target: str, by: str | None = None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Per group the counts, sums and cross products of rows without a gap; few numbers, since groups are folds."""
    columns = [*features, target]
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns))
    size = len(columns)
    found: dict[int, np.ndarray] = {}
    means = np.zeros(size)
    for r in cross_moments(whole, columns, by).collect():
        sums = found.setdefault(r[by] if by else 0, np.zeros((3, size, size)))
        sums[0, r.i, r.j] = sums[0, r.j, r.i] = r.n
        sums[1, r.i, r.j], sums[1, r.j, r.i] = r.si, r.sj
        sums[2, r.i, r.j] = sums[2, r.j, r.i] = r.sij
        means[r.i], means[r.j] = r.mi, r.mj
    return found, means


def linear_fit(df: DataFrame, features: Sequence[str], target: str, ridge: float = 1e-6) -> LinearFit:
    """A linear model from one pass of cross products; rows with a missing value take no part, an empty table predicts NaN."""
    found, means = _product_sums(df, features, target)
    return _solved(features, found.get(0, np.zeros((3, len(features) + 1, len(features) + 1))), means, ridge)


def linear_folds(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", ridge: float = 1e-6) -> dict[int, LinearFit]:
    """The model of every fold, fitted on all other folds: their sums are the total less the fold's own, so one pass serves all."""
    found, means = _product_sums(df, features, target, fold)
    total = sum(found.values())
    return {k: _solved(features, total - sums, means, ridge) for k, sums in sorted(found.items())}


def cross_validate_linear(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", ridge: float = 1e-6) -> DataFrame:
    """One row of metrics per fold: one pass for all models and one that scores every row by its fold's model."""
    fits = linear_folds(df, features, target, fold, ridge)
    guess = F.lit(None).cast("double")
    for k, fitted in fits.items():
        guess = F.when(F.col(fold) == k, fitted.predict()).otherwise(guess)
    scored = df.withColumn("prediction", guess).where(F.col("prediction").isNotNull() & F.col(target).isNotNull())
    return regression_metrics(scored, target, "prediction", [fold])


def fit(df: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    return _with_features(features, estimator).fit(df)


def baseline_importance(df: DataFrame, features: Sequence[str], target: str, trees: int = 300, depth: int = 12) -> DataFrame:
    """Random-forest importance of every feature against the target, with its percentage."""
    forest = fit(df, features, random_forest(target, trees, depth)).stages[-1]
    scores = forest.featureImportances.toArray()  # one number per feature
    total = float(scores.sum()) or 1.0
    rows = [(f, float(v), float(v) / total * 100.0) for f, v in zip(features, scores)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, importance_pct double").orderBy(F.desc("importance"), "feature")


def evaluate(model: PipelineModel, df: DataFrame, target: str) -> DataFrame:
    return regression_metrics(model.transform(df), target, "prediction")


def _kept(*frames: DataFrame) -> contextlib.ExitStack:
    """Rows that several fits read are held in the executors, and let go at the end, after the metrics have been worked out."""
    stack = contextlib.ExitStack()
    for frame in frames:
        frame.persist()
        stack.callback(frame.unpersist)
    return stack


def _measured(scored: DataFrame) -> DataFrame:
    """Metrics, a row or a few, worked out now."""
    return scored.sparkSession.createDataFrame(scored.collect(), scored.schema)


def leaderboard(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, models: dict[str, object]) -> DataFrame:
    """Fit every model on the training rows, measure on the test rows, rank by RMSE."""
    with _kept(train, test):
        rows = [_measured(evaluate(fit(train, features, estimator), test, target).withColumn("model", F.lit(name))) for name, estimator in models.items()]
    return rank_models(union_all(rows), "model")


def predict_grid(model: PipelineModel, cells: DataFrame) -> DataFrame:
    return model.transform(cells).select("grid_id", F.col("prediction").alias("predicted_lst"))


def cross_validate(df: DataFrame, features: Sequence[str], target: str, estimator, folds: int = 5, fold: str = "fold") -> DataFrame:
    """One row of metrics per fold. The loop runs over models; every fit and score is a Spark job over the same held rows."""
    rows = []
    with _kept(df):
        for k in range(folds):
            model = fit(df.where(F.col(fold) != k), features, estimator)
            rows.append(_measured(evaluate(model, df.where(F.col(fold) == k), target).withColumn("fold", F.lit(k))))
    return union_all(rows)


def search_parameters(train: DataFrame, features: Sequence[str], target: str, grid: dict[str, Sequence], validation: str = "validation", rounds: int = 100) -> DataFrame:
    """Boosted trees over a parameter grid, each judged on the marked validation rows; best first."""
    names, rows = list(grid), []
    with _kept(train):
        for values in product(*grid.values()):
            params = dict(zip(names, values))
            model = fit(train, features, boosted_trees(target, rounds, validation=validation, **params))
            rows.append(_measured(evaluate(model, train.where(F.col(validation)), target).withColumns({n: F.lit(v) for n, v in params.items()})))
    return union_all(rows).orderBy("rmse", *names)


def temporal_model(df: DataFrame, features: Sequence[str], target: str, date: str, rounds: int = 100, depth: int = 6) -> tuple[PipelineModel, DataFrame]:
    """Train on the earliest dates, stop early on the middle ones, measure on each part."""
    parts = split_by_date(df, date).withColumn("validation", F.col("split") == "validation")
    with _kept(parts):
        fitted = fit(parts.where("split <> 'test'"), features, boosted_trees(target, rounds, depth, validation="validation"))
        return fitted, _measured(regression_metrics(fitted.transform(parts), target, "prediction", ["split"]))
