"""Points in outlines against a ray cast over all edges."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from thermogrid.functions import RING_TYPE
from thermogrid.operators import outlines as O, spatial as S


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def some_points(rng, rings, count):
    """Random ones, and ones on, level with, and next to corners, on edges, and at corners of cells."""
    xs, ys = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
    wide, high = max(xs) - min(xs), max(ys) - min(ys)
    found = [(rng.uniform(min(xs) - wide / 9, max(xs) + wide / 9), rng.uniform(min(ys) - high / 9, max(ys) + high / 9)) for _ in range(count)]
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            t = rng.random()
            found += [(ax, ay), (rng.choice(xs), ay), (ax, rng.choice(ys)), (math.nextafter(ax, 9e9), ay), (ax, math.nextafter(ay, -9e9)), (ax + t * (bx - ax), ay + t * (by - ay))]
    found += [(rng.randint(-3, 30) * 1.0, rng.randint(-3, 30) * 1.0) for _ in range(count)]
    return found


def tangle(rng, corners, at, reach, whole):
    """Corners in any order, so that edges cross; whole numbers put corners and edges on the borders of cells."""
    pick = (lambda c: float(round(c))) if whole else (lambda c: c)
    return [(pick(at + rng.uniform(0, reach)), pick(at + rng.uniform(0, reach))) for _ in range(corners)]


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("size", [0.37, 1.0, 4.0, 100.0])
def test_same_as_a_ray_over_all_edges(spark, whole, size):
    rng = random.Random(f"{whole} {size}")
    outlines = [[tangle(rng, n, at, 25, whole)] for n, at in ((3, 0), (4, 0), (9, 0), (30, 0), (12, -40))]
    outlines += [[[(0, 0), (20, 0), (20, 20), (0, 20)], [(5, 5), (15, 5), (15, 15), (5, 15)], [(7.5, 8), (9, 8), (9, 12)]]]
    for rings in outlines:
        points = some_points(rng, rings, 150)
        df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
        marked = {r.i: r.inside for r in O.mark_inside(df, O.ring_rows(spark, *rings), "x", "y", size).collect()}
        assert len(marked) == len(points)
        wrong = [p for i, p in enumerate(points) if marked[i] != inside(rings, *p)]
        assert wrong == []


def test_degrees_far_from_the_origin(spark):
    rng = random.Random(8)
    ring = [(85.7 + math.cos(t / 200 * math.tau) * rng.uniform(0.02, 0.1), 20.1 + math.sin(t / 200 * math.tau) * rng.uniform(0.02, 0.1)) for t in range(200)]
    points = some_points(rng, [ring], 2000)
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    got = {r.i for r in S.select_in_polygon(df, "x", "y", ring).collect()}
    assert got == {i for i, p in enumerate(points) if inside([ring], *p)}


def test_no_position_no_area_no_ring(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 1.0, 1.0), (3, 1.0, 1.0)], "i int, x double, y double")
    box = O.ring_rows(spark, [(-5, -5), (5, -5), (5, 5), (-5, 5)])
    assert sorted((r.i, r.inside) for r in O.mark_inside(df, box, "x", "y", 2.0).collect()) == [(1, False), (2, False), (3, True), (3, True)]
    for ring in ([], [(1, 1)], [(0, 1), (4, 1), (2, 1)]):
        assert O.where_inside(df, O.ring_rows(spark, ring), "x", "y", 2.0).count() == 0
    assert O.where_inside(df, spark.createDataFrame([(None,)], f"ring {RING_TYPE}"), "x", "y", 2.0).count() == 0
    assert O.where_inside(df.limit(0), box, "x", "y", 2.0).count() == 0


def test_points_in_several_areas_come_once(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 9.0, 9.0), (1, 1.0, 1.0)], "grid_id int, x double, y double")
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    areas = spark.createDataFrame([("Park", square(0.0, 2.0)), ("PARK", square(0.0, 4.0)), ("park", square(0.0, 2.0)), ("lake", square(8.0, 10.0))], f"name string, coords {RING_TYPE}")
    assert sorted(r.grid_id for r in S.select_in_named_area(df, areas, "Park", "x", "y", 0.7).collect()) == [1, 1, 2]


def test_margin_of_an_outline(spark):
    rng = random.Random(2)
    ring = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(12)] + [(20.0, 4.0), (25.0, 4.0)]
    points = [(rng.uniform(-3, 28), rng.uniform(-3, 12)) for _ in range(800)]

    def gap(px, py, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)

    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    got = {r.i for r in O.where_near(df, O.ring_rows(spark, ring), "x", "y", 1.3, 0.8).collect()}
    assert got == {i for i, p in enumerate(points) if min(gap(*p, a, b) for a, b in zip(ring, [*ring[1:], ring[0]])) <= 0.8}


def test_points_look_at_the_edges_of_their_cell_only(spark):
    ring = [(math.cos(t / 20000 * math.tau), math.sin(t / 20000 * math.tau)) for t in range(20000)]
    cover = O.outline_cover(O.ring_rows(spark, ring), O.cell_side(ring)).select(F.size("pieces").alias("n"))
    most, rows, edges = cover.agg(F.max("n"), F.count("n"), F.sum("n")).first()
    assert most < 150 and rows < 512 * 512 and edges < 2 * 20000
