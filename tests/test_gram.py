"""Cross products, correlations and linear models against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermogrid.operators import gram, stats as ST
from thermogrid.plans import models as MD


def table(spark, values, names, parts=5):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in values]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts)


def test_correlations_with_gaps_and_large_offsets(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 5)) @ rng.normal(size=(5, 5)) + [0, 5e8, -3, 1e4, 0.1]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 0.1  # does not vary
    names = list("abcde")
    got = {(r.left, r.right): r["corr"] for r in ST.correlation_matrix(table(spark, x, names), names).collect()}
    assert len(got) == 10
    for i in range(5):
        for j in range(i + 1, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if j == 4:
                assert got[names[i], "e"] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7)


def test_many_columns_stay_one_pass(spark):
    names = [f"v{k}" for k in range(90)]
    df = spark.range(500).select(*[((F.col("id") * (k + 3)) % (97 + k)).cast("double").alias(n) for k, n in enumerate(names)])
    got = ST.correlation_matrix(df, names)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = {(r.left, r.right): r["corr"] for r in got.collect()}
    want = df.select(F.corr("v3", "v71")).first()[0]
    assert len(rows) == 90 * 89 // 2 and rows["v3", "v71"] == pytest.approx(want, abs=1e-9)


def test_nothing_to_correlate(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [(r.left, r["corr"]) for r in ST.correlation_matrix(empty, ["a", "b"]).collect()] == [("a", None)]


def test_linear_folds_equal_separate_fits(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)) * [1, 50, 0.01] + [0, 1000, 7]
    y = 3 + x @ [2.0, -0.5, 90.0] + rng.normal(size=600)
    fold = rng.integers(0, 4, 600)
    df = spark.createDataFrame([(*map(float, r), float(t), int(f)) for r, t, f in zip(x, y, fold)] + [(None, 1.0, 1.0, 5.0, 2)], "a double, b double, c double, y double, fold int")
    fits = MD.linear_folds(df, ["a", "b", "c"], "y")
    metrics = {r.fold: r for r in MD.cross_validate_linear(df, ["a", "b", "c"], "y").collect()}
    assert set(fits) == set(metrics) == {0, 1, 2, 3}
    for k, f in fits.items():
        train = np.column_stack([np.ones((fold != k).sum()), x[fold != k]])
        want = np.linalg.lstsq(train, y[fold != k], rcond=None)[0]
        assert (f.intercept, *f.weights) == pytest.approx(tuple(want), rel=1e-3, abs=1e-2)
        guess = f.intercept + x[fold == k] @ np.array(f.weights)
        assert metrics[k].rmse == pytest.approx(np.sqrt(np.mean((guess - y[fold == k]) ** 2)), rel=1e-9)
        assert metrics[k].n == (fold == k).sum()


def test_features_that_do_not_vary_or_repeat(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), F.lit(2.5).alias("flat"), F.col("id").cast("double").alias("again"), (F.col("id") * 3.0 + 1).alias("y"))
    fitted = MD.linear_fit(df, ["a", "flat", "again"], "y")
    assert fitted.weights[1] == 0.0 and fitted.weights[0] == pytest.approx(1.5, rel=1e-3) == fitted.weights[2]
    assert df.select(F.max(F.abs(fitted.predict() - F.col("y")))).first()[0] < 0.01
    nothing = MD.linear_fit(df.limit(0), ["a"], "y")
    assert np.isnan(nothing.intercept) and nothing.weights == (0.0,)


def test_groups_beyond_what_a_task_keeps(spark):
    df = spark.range(2000).select((F.col("id") % 300).alias("g"), F.col("id").cast("double").alias("a"))
    rows = gram.cross_moments(df, ["a"], "g").collect()
    assert len(rows) == 300 and all(r.n == len(range(r.g, 2000, 300)) for r in rows)
