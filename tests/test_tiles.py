"""Neighbourhoods in small tiles against plain loops, and plans without a window or key wider than a tile."""

from __future__ import annotations

import random
import re

import pytest

from thermogrid.operators import raster as RS, spatial as S, tiles as T

SIDES = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def scattered():
    draw = random.Random(3)
    return {(draw.randint(-9, 30), draw.randint(-9, 30)) for _ in range(700)}


@pytest.mark.parametrize("size", [3, 256])
def test_neighbours_of_scattered_pixels(spark, scattered, size):
    rows = [("a", r, c, float(r * 100 + c)) for r, c in scattered] + [("b", r, c, float(r * 100 + c) + 0.5) for r, c in scattered if (r + c) % 3]
    held = {(k, r, c): v for k, r, c, v in rows}
    df = spark.createDataFrame(rows, "k string, row int, col long, v double").repartition(4)
    got = T.neighbours(df, "v", by=["k"], size=size).collect()
    assert len(got) == len(rows)
    for x in got:
        for side, (dr, dc) in SIDES.items():
            assert x[side] == held.get((x.k, x.row + dr, x.col + dc))


def test_one_shuffle_by_tile(spark):
    df = spark.range(5000).selectExpr("id div 70 AS row", "id % 70 AS col", "CAST(id AS double) AS v")
    text = plan(T.neighbours(df, "v"))
    assert len(re.findall(r"Exchange hashpartitioning\(", text)) == 1 and "hashpartitioning(_ty" in text and "Join" not in text
    assert all("_ty" in w for w in re.findall(r"Window \[.*", text))
    edges = S.lattice_edges(df.selectExpr("id AS grid_id" if "id" in df.columns else "row * 70 + col AS grid_id", "row AS iy", "col AS ix", "v AS lst", "v / 1000 AS lon", "v / 1000 AS lat"), "lst", spark.createDataFrame([(1.0, 1.0)], "p60 double, std double"), 0.3)
    assert "Join" not in plan(edges) and edges.count() == sum(1 for i in range(5000) for dr, dc in SIDES.values() if 0 <= i % 70 + dc < 70 and 0 <= (i // 70 + dr) * 70 + i % 70 + dc < 5000)
    filled = plan(RS.fill_nodata(df, "v"))
    assert all("_chunk" in w for w in re.findall(r"Window \[(?:lag|lead)\(.*", filled))


def fill(grid):
    """Rows and columns of any start and length; a plain pass after pass."""
    z = dict(grid)
    for _ in range(2):
        for axis in (0, 1):
            for step in (-1, 1):
                lines = {}
                for p in z:
                    lines.setdefault(p[axis], []).append(p)
                new = dict(z)
                for line in lines.values():
                    line.sort()
                    for i, p in enumerate(line):
                        if z[p] is None:
                            new[p] = z[line[(i + step) % len(line)]]
                z = new
    return z


@pytest.mark.parametrize("size", [2, 64])
def test_fill_wraps_and_follows_ragged_lines(spark, size, monkeypatch):
    monkeypatch.setattr(T, "TILE", size)
    monkeypatch.setattr(T.chunked_lines, "__defaults__", (size, ()))
    draw = random.Random(size)
    grid = {(k // 13, k % 13): draw.choice([None, None, float(k)]) for k in range(7, 160)}
    df = spark.createDataFrame([(r, c, v, "x") for (r, c), v in grid.items()], "row int, col int, v double, _note string").repartition(3)
    want = fill(grid)
    some = sorted(v for v in want.values() if v is not None)
    median = (some[len(some) // 2] + some[(len(some) - 1) // 2]) / 2
    got = {(r.row, r.col): r.filled for r in RS.fill_nodata(df, "v").collect()}
    assert got == {p: median if v is None else v for p, v in want.items()}
