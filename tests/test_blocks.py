"""Nearest features by blocks of queries: far queries, repeated ids, places without coordinates, and how little a block looks at."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermogrid.operators import spatial as S
from thermogrid.operators.blocks import _Spots


@pytest.mark.parametrize("k", [1, 4])
def test_candidates_hold_the_k_nearest_of_every_query(k):
    draw = np.random.default_rng(k)
    a = np.vstack([draw.uniform(0, 1000, (3000, 2)), np.tile([[10.0, 10.0]], (50, 1))])
    way = np.where(np.arange(len(a))[:, None] % 3 == 0, draw.uniform(-40, 40, a.shape), 0.0)
    spots = _Spots(a, a + way, np.ones(len(a), np.int64), k)
    for q in (draw.uniform(-200, 1200, (700, 2)), draw.uniform(0, 3000, (700, 2)) + [0.0, 7.5e6]):
        d = spots.distances(q, np.arange(len(a)))
        qi, at = spots.candidates(q)
        found = set(zip(qi.tolist(), at.tolist()))
        limit = np.sort(d, axis=1)[:, k - 1]
        assert all((int(i), int(j)) in found for i, j in zip(*np.nonzero(d < limit[:, None])))
        assert all(np.sum(d[i, at[qi == i]] <= limit[i]) >= k for i in range(len(q)))


def test_a_far_block_looks_at_few_spots(spark):
    """Queries a long way off met every spot within a leaf's height of the edge, each by itself."""
    draw = random.Random(3)
    features = [(i, draw.uniform(0, 12000), draw.uniform(0, 12000)) for i in range(6000)]
    queries = [(i, 50.0 + 100 * (i % 120), 5e6 + 100 * (i // 120)) for i in range(2400)]
    f = spark.createDataFrame(features, "feature_id long, x1 double, y1 double").withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    q = spark.createDataFrame(queries, "query_id long, qx double, qy double")
    placed, levels = S._packed_tree(f, "feature_id", [], 4, None, 64)
    leaves, crowded = S._block_leaves(S._query_blocks(q, "query_id", placed), placed, levels, 4, False)
    assert leaves.count() < 1500 and crowded.isEmpty()  # a few dozen leaves a block, not a query
    got = {(r.query_id, r["rank"]): r.feature_id for r in S.nearest_features(q, f, 4).collect()}
    for i, x, y in queries[::97]:
        want = sorted((math.hypot(px - x, py - y), fid) for fid, px, py in features)[:4]
        assert [got[i, r + 1] for r in range(4)] == [fid for _, fid in want]


def test_a_feature_without_an_end_is_near_nothing(spark):
    """It used to come first wherever its leaf was met."""
    rows = [(1, 0.0, 0.0, None, 0.0), (2, 5.0, 0.0, 5.0, 9.0), (3, 50.0, 0.0, 50.0, 9.0)]
    f = spark.createDataFrame(rows, "feature_id long, x1 double, y1 double, x2 double, y2 double")
    q = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 60.0, 4.0)], "query_id long, qx double, qy double")
    got = sorted((r.query_id, r.feature_id, r.distance) for r in S.nearest_features(q, f).collect())
    assert got == [(1, 2, 5.0), (2, 3, 10.0)]
