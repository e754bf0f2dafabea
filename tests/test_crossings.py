"""Meeting points of pieces: brute force, crowds of short pieces, many pieces side by side."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from thermogrid.operators import spatial as S

SCHEMA = "segment_id long, x1 double, y1 double, x2 double, y2 double"


def brute(rows):
    found = []
    for k, (_, x1, y1, x2, y2) in enumerate(rows):
        for _, u1, v1, u2, v2 in rows[k + 1:]:
            turn = (x2 - x1) * (v2 - v1) - (y2 - y1) * (u2 - u1)
            if turn:
                t = ((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1)) / turn
                u = ((u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1)) / turn
                if 0 <= t <= 1 and 0 <= u <= 1:
                    found.append((round(x1 + t * (x2 - x1), 5), round(y1 + t * (y2 - y1), 5)))
    return sorted(found)


def crowd(rng, n, corner, width, length):
    return [(0, x := corner + rng.random() * width, y := corner + rng.random() * width, x + rng.uniform(-length, length), y + rng.uniform(-length, length)) for _ in range(n)]


def test_crowds_are_cut_up_and_nothing_is_lost(spark):
    rng = random.Random(11)
    rows = crowd(rng, 60, 0.0, 900.0, 300.0) + crowd(rng, 700, 310.0, 80.0, 4.0)
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    dealt = S._dealt_pieces(df, 100.0)
    assert {r.step for r in dealt.select("step").distinct().collect()} >= {100.0, 25.0}
    assert S._meeting_pairs(dealt).count() < 700 * 699 / 2 / 4
    got = sorted((round(r.x, 5), round(r.y, 5)) for r in S._crossings(dealt).collect())
    assert got == brute(rows)


def test_pieces_side_by_side_are_not_compared(spark):
    many = spark.range(20000).select(F.col("id").alias("segment_id"), F.lit(5.0).alias("x1"), (F.col("id") * 0.004 + 2).alias("y1"), F.lit(95.0).alias("x2"), (F.col("id") * 0.004 + 2).alias("y2"))
    across = spark.createDataFrame([(-1, 50.0, 1.0, 50.0, 99.0), (-2, 50.0, 1.0, 50.0, 99.0)], SCHEMA)
    both = many.unionByName(across).unionByName(many)  # every piece twice
    dealt = S._dealt_pieces(both, 100.0)
    assert S._meeting_pairs(dealt).count() == 20000
    points = many.select(F.col("x1").alias("x"), F.col("y1").alias("y"))
    near = S._pieces_at(points, dealt, 100.0, 0.001)
    assert near.count() == 20000
    nodes = S.network_nodes(both)
    assert nodes.where("pieces = 4").count() == 20000 == nodes.count()


def test_points_of_no_length_and_an_empty_layer(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 5.0), (2, 0.0, 5.0, 10.0, 5.0)], SCHEMA)
    assert S.crossings(df).count() == 0 and S.network_nodes(df).count() == 0
    assert S.crossings(df.limit(0)).count() == 0


def brute_nodes(rows):
    """Every point against every piece."""
    import math

    pieces = sorted({r[1:] for r in rows})
    at = lambda v: round(v * 1000.0) / 1000.0
    points = {(at(p[k]), at(p[k + 1])) for p in pieces for k in (0, 2) if None not in p[k : k + 2]}
    pieces = [p for p in pieces if None not in p and p[:2] != p[2:]]
    for i, (x1, y1, x2, y2) in enumerate(pieces):
        ax, ay = x2 - x1, y2 - y1
        for u1, v1, u2, v2 in pieces[i + 1 :]:
            bx, by, gx, gy = u2 - u1, v2 - v1, u1 - x1, v1 - y1
            if turn := ax * by - ay * bx:
                t, u = (gx * by - gy * bx) / turn, (gx * ay - gy * ax) / turn
                if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                    points.add((at(x1 + t * ax), at(y1 + t * ay)))
    out = {}
    for x, y in points:
        ways = set()
        for x1, y1, x2, y2 in pieces:
            dx, dy = x2 - x1, y2 - y1
            f = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            if math.hypot(x1 + f * dx - x, y1 + f * dy - y) <= 0.001:
                for ex, ey in ((x1, y1), (x2, y2)):
                    if (far := math.hypot(ex - x, ey - y)) > 0.002:
                        ways.add((round((ex - x) / far * 1e4), round((ey - y) / far * 1e4)))
        if len(ways) >= 3:
            out[x, y] = len(ways)
    return out


def test_nodes_against_brute_force(spark):
    rng = random.Random(3)
    raster = [(x := rng.randint(-6, 12) * 25.0, y := rng.randint(-6, 12) * 25.0, x + rng.choice((0, 50.0, 75.0)), y + rng.choice((0, 50.0, 25.0))) for _ in range(150)]
    rows = crowd(rng, 50, -50.0, 500.0, 300.0) + crowd(rng, 120, 210.0, 40.0, 4.0) + [(0, *r) for r in raster] + [(0, *r) for r in raster[:9]]
    rows += [(0, 61.0, None, 100.0, 100.0), (0, 100.0, 75.0, None, None), (0, 33.0, 7.0, 33.0, 7.0), (0, 33.0, 0.0, 33.0, 20.0), (0, 20.0, 7.0, 40.0, 7.0)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    want = brute_nodes(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(want) > 300
    for size in (100.0, 37.3):
        got = S.network_nodes(df, size=size)
        assert sorted((r.x, r.y, r.pieces) for r in got.collect()) == sorted((*k, n) for k, n in want.items())


def test_squares_are_quartered_and_nothing_is_lost(spark, monkeypatch):
    import numpy as np

    from thermogrid.operators import nodes as N

    rng = random.Random(4)
    rows = crowd(rng, 60, 0.0, 100.0, 80.0) + [(0, 50.0, 0.0, 50.0, 100.0), (0, 0.0, 25.0, 100.0, 25.0)]
    slope = [(d - b) / (c - a) if c != a else np.inf for _, a, b, c, d in rows]
    order = np.argsort(slope)
    p, slope = np.array([r[1:] for r in rows]).T[:, order], np.array(slope)[order]
    want = {k: n for k, n in brute_nodes(rows).items() if 0 <= k[0] < 100 and 0 <= k[1] < 100}
    for work, chunk in ((N._WORK, N._MET), (500, 50)):
        monkeypatch.setattr(N, "_WORK", work)
        monkeypatch.setattr(N, "_MET", chunk)
        got = [(float(x), float(y), int(n)) for part in N.square_nodes(p, slope, (100.0, 0, 0), 3, 1000.0, 0.001) for x, y, n in zip(*part)]
        assert sorted(got) == sorted((*k, n) for k, n in want.items())


def test_crossings_stay_where_they_are_found(spark):
    """Every crossing was a row that moved, several times."""
    lines = spark.range(1000).select((F.col("id") * 0.09 + 5).alias("at"))
    up = lines.select(F.col("at").alias("x1"), F.lit(1.0).alias("y1"), F.col("at").alias("x2"), F.lit(99.0).alias("y2"))
    along = lines.select(F.lit(1.0).alias("x1"), F.col("at").alias("y1"), F.lit(99.0).alias("x2"), F.col("at").alias("y2"))
    got = S.network_nodes(up.unionByName(along))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert got.where("pieces = 4").count() == 1_000_000 == got.count()
