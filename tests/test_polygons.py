"""Coverage of cells by outlines against clipping every cell."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from thermogrid.functions import RING_TYPE, area_centroid, clip_to_box, ring_area
from thermogrid.operators import grid as G

SIZE = 10.0


def table(spark, rings):
    return spark.createDataFrame([(i, r, hole) for i, (r, hole) in enumerate(rings)], f"k int, ring {RING_TYPE}, hole boolean")


def by_clipping(spark, rings):
    """(ix, iy): signed area from the ring cut to each cell of its box."""
    found: dict[tuple[int, int], float] = {}
    for ring, hole in rings:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        cells = [(ix, iy) for ix in range(math.floor(min(xs) / SIZE), math.ceil(max(xs) / SIZE) + 1) for iy in range(math.floor(min(ys) / SIZE), math.ceil(max(ys) / SIZE) + 1)]
        df = spark.createDataFrame(cells, "ix long, iy long").crossJoin(table(spark, [(ring, hole)]))
        piece = clip_to_box("ring", F.col("ix") * SIZE, F.col("iy") * SIZE, (F.col("ix") + 1) * SIZE, (F.col("iy") + 1) * SIZE)
        for r in df.select("ix", "iy", ring_area(piece).alias("a")).collect():
            found[(r.ix, r.iy)] = found.get((r.ix, r.iy), 0.0) + (-r.a if hole else r.a)
    return {k: v for k, v in found.items() if v > 1e-8}


def star(rng, points, cx, cy, reach):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(points))
    return [(cx + math.cos(t) * (r := rng.uniform(0.2, 1) * reach), cy + math.sin(t) * r) for t in turns]


@pytest.mark.parametrize("at", [(0.0, 0.0), (-37.5, 400000.0)])
def test_any_outline_with_holes_and_parts(spark, at):
    rng = random.Random(3)
    rings = [(star(rng, 23, at[0] + 70, at[1] + 55, 60), False), (star(rng, 9, at[0] + 200, at[1] + 50, 45)[::-1], False)]
    rings += [([(at[0] + 195, at[1] + 45), (at[0] + 203, at[1] + 45), (at[0] + 203, at[1] + 53)], True)]
    got = {(r.ix, r.iy): r.area for r in G.polygon_overlap_per_cell(table(spark, rings), SIZE).collect()}
    want = by_clipping(spark, rings)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_edges_on_cell_borders_and_centroids(spark):
    box = [(10.0, 20.0), (10.0, 50.0), (40.0, 50.0), (40.0, 20.0)]
    got = G.polygon_coverage(table(spark, [(box, False)]), SIZE).collect()
    assert {(r.ix, r.iy) for r in got} == {(x, y) for x in (1, 2, 3) for y in (2, 3, 4)}
    assert all((r.area, r.mx, r.my) == pytest.approx((100.0, 500.0, 500.0)) for r in got)
    slanted = [(3.0, 1.0), (27.0, 6.0), (12.0, 28.0)]
    for r in G.polygon_coverage(table(spark, [(slanted, False)]), SIZE).collect():
        piece = spark.range(1).select(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in slanted]).alias("ring"))
        c = piece.select(area_centroid(clip_to_box("ring", F.lit(r.ix * SIZE), F.lit(r.iy * SIZE), F.lit((r.ix + 1) * SIZE), F.lit((r.iy + 1) * SIZE))).alias("c")).first().c
        assert (r.mx / r.area + r.ix * SIZE, r.my / r.area + r.iy * SIZE) == pytest.approx((c.x, c.y), abs=1e-6)


def test_layers_stay_apart_and_odd_rings_cover_nothing(spark):
    box = lambda x: [(x, 0.0), (x + 10.0, 0.0), (x + 10.0, 10.0), (x, 10.0)]
    rows = [(box(0.0), False), (box(0.0), False), ([], False), (None, False), ([(0.0, 0.0), (5.0, 5.0)], False), ([(0.0, 0.0), (5.0, 5.0), (9.0, 9.0)], False)]
    df = table(spark, rows)
    assert [r.area for r in G.polygon_overlap_per_cell(df, SIZE).collect()] == [pytest.approx(200.0)]
    assert sorted((r.k, r.area) for r in G.polygon_overlap_per_cell(df, SIZE, ["k"]).collect()) == [(0, pytest.approx(100.0)), (1, pytest.approx(100.0))]
    assert G.polygon_overlap_per_cell(df.limit(0), SIZE).count() == 0


def test_a_wide_polygon_moves_its_outline_only(spark):
    wide = [(0.0, 0.0), (100000.0, 0.0), (100000.0, 30.0), (0.0, 30.0)]
    got = G.polygon_overlap_per_cell(table(spark, [(wide, False)]), SIZE)
    assert got.count() == 30000
    outline = G._outline_pieces(table(spark, [(wide, False)]), SIZE, [])
    assert outline.count() == 6  # two upright edges in three rows: level edges bound nothing
