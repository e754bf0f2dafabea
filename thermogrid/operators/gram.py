"""Cross products of many columns in one pass: the base of correlations and of linear models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

__all__ = ["cross_moments", "pair_correlations"]

_SUMS = ("n", "si", "sj", "sii", "sjj", "sij")
_KEPT_KEYS = 64  # groups a task adds up before it hands their sums on


def _shift(df: DataFrame, columns: Sequence[str]) -> Column:
    """Means of all columns, one row, as a scalar."""
    value = lambda c: F.col(c).cast("double")
    return df.agg(F.struct(*[F.coalesce(F.avg(F.nanvl(value(c), F.lit(None).cast("double"))), F.lit(0.0)).alias(c) for c in columns]).alias("s")).scalar()


def cross_moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Sums over rows where both columns of a pair are present (NaN counts as absent), values taken from the column's mean.

    Rows (by, i, j, n, si, sj, sii, sjj, sij, mi, mj) for positions i <= j in `columns`; mi and mj are the means taken off, so that
    large offsets cost no digits. A task multiplies blocks of rows as matrices and sends one row per pair and group.
    """
    shift = _shift(df, columns)
    names = [f"c{k}" for k in range(len(columns))]
    key = F.col(by).cast("long") if by else F.lit(0).cast("long")
    centred = df.select(key.alias("key"), *[(F.col(c).cast("double") - shift[c]).alias(n) for c, n in zip(columns, names)])
    size = len(columns)
    upper = np.triu_indices(size)

    def rows(sums: dict) -> pa.RecordBatch:
        keys = list(sums)
        block = {"key": pa.array([k for k in keys for _ in range(len(upper[0]))], pa.int64())}
        for name, places in (("i", upper[0]), ("j", upper[1])):
            block[name] = pa.array(np.tile(places, len(keys)).astype(np.int32))
        for at, name in enumerate(_SUMS):
            block[name] = pa.array(np.concatenate([sums[k][at][upper] for k in keys]))
        return pa.RecordBatch.from_pydict(block)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            keys = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            values = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(size)])
            there = ~np.isnan(values)
            values, mask = np.where(there, values, 0.0), there.astype(np.float64)
            for key_value in np.unique(keys):
                at = keys == key_value
                x, m = values[at], mask[at]
                linear, square = x.T @ m, (x * x).T @ m
                part = np.stack([m.T @ m, linear, linear.T, square, square.T, x.T @ x])
                sums[int(key_value)] = sums.get(int(key_value), 0.0) + part
            if len(sums) > _KEPT_KEYS:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    parts = centred.mapInArrow(multiply, "key long, i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    total = parts.groupBy("key", "i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    means = F.array(*[shift[c] for c in columns])
    group = [F.when(F.col("key") > -(1 << 63), F.col("key")).alias(by)] if by else []
    return total.select(*group, "i", "j", F.col("n").cast("long").alias("n"), *_SUMS[1:], F.get(means, F.col("i")).alias("mi"), F.get(means, F.col("j")).alias("mj"))


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, corr): Pearson correlation of every pair of columns over rows where both are present.

    Null where a side does not vary (differences below 1e-12 of the mean are taken for rounding) or no row has both.
    """
    n = F.col("n")

    def spread(square: str, linear: str, mean: str) -> Column:
        left = F.col(square) - F.col(linear) * F.col(linear) / n
        return F.when(left > n * F.pow(F.abs(F.col(mean)) * F.lit(1e-12), F.lit(2.0)), left)

    scale = F.sqrt(spread("sii", "si", "mi") * spread("sjj", "sj", "mj"))
    corr = (F.col("sij") - F.col("si") * F.col("sj") / n) / scale
    corr = F.when(scale.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr)))
    found = cross_moments(df, columns).where("i < j AND n > 0").select("i", "j", corr.alias("corr"))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wanted = df.sparkSession.createDataFrame(pairs, "i int, j int")  # an empty table has no products, but keeps its pairs
    names = F.array(*[F.lit(c) for c in columns])
    joined = wanted.join(F.broadcast(found), ["i", "j"], "left")  # one row a pair of columns
    return joined.select(F.get(names, F.col("i")).alias("left"), F.get(names, F.col("j")).alias("right"), "corr")
