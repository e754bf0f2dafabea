"""Model quality: regression metrics, confusion table, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from thermogrid.operators.stats import attach_quantiles

__all__ = ["regression_metrics", "fold_summary", "tercile_classes", "confusion_summary"]


def regression_metrics(df: DataFrame, target: str, predicted: str, by: Sequence[str] = (), min_rows: int = 1) -> DataFrame:
    """RMSE, MAE, R2 and MAPE in one aggregate; groups below `min_rows` are left out."""
    t, e = F.col(target), F.col(predicted) - F.col(target)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(t).alias("_var"),
        (F.avg(F.abs(e) / F.greatest(F.abs(t), F.lit(1e-9))) * F.lit(100.0)).alias("mape"),
    )
    r2 = F.when(F.col("_var") > 0, F.lit(1.0) - F.col("_sse") / (F.col("_var") * F.col("n")))
    return sums.where(F.col("n") >= min_rows).select(*by, "n", "rmse", "mae", r2.alias("r2"), "mape")


def fold_summary(metrics: DataFrame, columns: Sequence[str] = ("rmse", "mae", "r2", "mape")) -> DataFrame:
    """Mean and sample deviation across folds (0 for a single fold)."""
    return metrics.agg(*[
        a for c in columns for a in (F.avg(c).alias(c), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))
    ])


def tercile_classes(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """Actual and predicted class by the terciles of the target; predictions outside its range get null."""
    df = attach_quantiles(df, "_e", df, target, [0.0, 1 / 3, 2 / 3, 1.0])
    e0, e1, e2, e3 = (F.col("_e")[i] for i in range(4))

    def cls(column: str):
        v = F.col(column)
        return (
            F.when((v < e0) | (v > e3), F.lit(None).cast("string"))
            .when(v <= e1, F.lit("Low")).when(v <= e2, F.lit("Medium")).when(v <= e3, F.lit("High"))
        )

    return df.withColumns({"actual_class": cls(target), "predicted_class": cls(predicted)}).drop("_e")


def confusion_summary(classes: DataFrame) -> DataFrame:
    """Nine rows (actual_class, predicted_class, n), each with accuracy, Cohen's kappa and the misclassified rows.

    One aggregate of nine counts gives all of it. Accuracy is over all rows, kappa over rows with both classes.
    """
    labels = ["Low", "Medium", "High"]
    cells = {
        f"c{i}{j}": F.count_if((F.col("actual_class") == a) & (F.col("predicted_class") == b)).cast("double")
        for i, a in enumerate(labels) for j, b in enumerate(labels)
    }
    m = classes.agg(F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in cells.items()])
    c = [[F.col(f"c{i}{j}") for j in range(3)] for i in range(3)]
    hit = c[0][0] + c[1][1] + c[2][2]
    n = sum((c[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    chance = sum(
        ((c[i][0] + c[i][1] + c[i][2]) * (c[0][i] + c[1][i] + c[2][i]) for i in range(3)), F.lit(0.0)
    ) / (n * n)
    rows = F.array(*[
        F.struct(F.lit(a).alias("actual_class"), F.lit(b).alias("predicted_class"), c[i][j].cast("long").alias("n"))
        for i, a in enumerate(labels) for j, b in enumerate(labels)
    ])
    return m.select(
        F.inline(rows), (hit / F.col("rows")).alias("accuracy"),
        F.when(chance < 1, (hit / n - chance) / (F.lit(1.0) - chance)).alias("kappa"),
        (F.col("rows") - hit).cast("long").alias("misclassified"),
    )
