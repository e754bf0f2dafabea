"""Cuts in an order of rows against sorting them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from thermogrid.operators.selection import cut_of_order
from thermogrid.plans import models as MD


@pytest.mark.parametrize("bits, spread", [(31, 2**31), (31, 5), (20, 2**20), (3, 8)])
def test_same_rows_as_sorting(spark, bits, spread):
    rng = random.Random(bits + spread)
    rows = [(rng.randrange(spread), rng.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1), (1, None)], "key long, id int")
    for n in (1, 7, 150, 299, 300, 1000):
        cut = cut_of_order(df, F.col("key"), bits, "id", lambda _: n)
        first = sorted(rows)[:n]
        assert (cut.key, cut.id) == first[-1]
        assert sorted(tuple(r) for r in df.where(cut.before(F.col("key"), "id")).collect()) == [r for r in first if r != first[-1]]
        assert cut.left == first.count(first[-1]) and cut.held == rows.count(first[-1])
    assert cut_of_order(df, F.col("key"), bits, "id", lambda total: total - 300) is None
    assert cut_of_order(df.limit(0), F.col("key"), bits, "id", lambda _: 5) is None


def test_samples_of_any_size_with_a_hot_id(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("grid_id"), (F.col("id") % 11).alias("v"))
    for n in (0, 1, 50, 3999, 6000, 9000):
        a, b = MD.fixed_sample(df, "grid_id", n), MD.fixed_sample(df.repartition(5), "grid_id", n)
        assert a.count() == min(n, 6000)
        assert a.exceptAll(b).isEmpty()


def test_slice_follows_ids_and_needs_no_join_or_sort(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") != 8, F.col("id")).alias("grid_id"))
    out = MD.early_stopping_slice(df, "grid_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan and "Exchange" not in plan
    assert out.count() == 9000 and out.where("validation is null or (grid_id is null and validation)").isEmpty()
    sides = {r.grid_id: (r.a, r.n) for r in out.groupBy("grid_id").agg(F.count_distinct("validation").alias("a"), F.sum(F.col("validation").cast("int")).alias("n")).collect()}
    assert all(a == 1 for a, _ in sides.values())
    taken = sum(n for _, n in sides.values())
    assert taken == 899 or (sides[7][1] == 3000 and taken <= 899 + 3000)
