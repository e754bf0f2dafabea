"""Operators on small tables made here, against brute force or a closed form."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermogrid import functions as fn
from thermogrid.operators import grid as G, keyed as KY, raster as RS, series as SR, spatial as S, stats as ST


@pytest.fixture(scope="module")
def skewed():
    """A third of all points in one place, the rest spread unevenly."""
    rng = np.random.default_rng(7)
    spread = rng.gamma(1.5, 900.0, size=(600, 2))
    hot = np.tile([[431.25, 977.5]], (300, 1))
    pts = np.vstack([spread, hot])
    return [(i, float(x), float(y), float(i % 13)) for i, (x, y) in enumerate(pts)]


def as_features(spark, rows):
    return spark.createDataFrame(rows, "feature_id long, x1 double, y1 double, z double").withColumns({"x2": F.col("x1"), "y2": F.col("y1")})


@pytest.mark.parametrize("k,depth", [(1, None), (1, 4), (4, None), (4, 3)])
def test_nearest_features_equals_brute_force(spark, skewed, k, depth):
    rng = np.random.default_rng(11)
    queries = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2000, 6000, size=(150, 2)))]
    q = spark.createDataFrame(queries, "query_id long, qx double, qy double")
    out = S.nearest_features(q, as_features(spark, skewed), k, depth=depth).collect()
    got: dict[int, list] = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["feature_id"], r["distance"]))
    assert len(got) == len(queries)
    for i, x, y in queries:
        want = sorted((math.hypot(px - x, py - y), fid) for fid, px, py, _ in skewed)[:k]
        have = [(d, f) for _, f, d in sorted(got[i])]
        assert [f for _, f in have] == [f for _, f in want]
        assert have[0][0] == pytest.approx(want[0][0], abs=1e-9)


def test_nearest_features_of_segments_and_empty_layer(spark):
    q = spark.createDataFrame([(1, 5.0, 3.0), (2, 100.0, 100.0)], "query_id long, qx double, qy double")
    segs = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 90.0, 0.0, 90.0, 200.0)], "feature_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["query_id"]: (r["feature_id"], r["distance"]) for r in S.nearest_features(q, segs).collect()}
    assert got == {1: (1, 3.0), 2: (2, 10.0)}
    assert S.nearest_features(q, segs.where("feature_id < 0")).count() == 0


def test_inverse_distance_uses_the_station_on_the_spot(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "query_id long, qx double, qy double")
    st = as_features(spark, [(1, 0.0, 0.0, 10.0), (2, 3.0, 0.0, 40.0)])
    near = S.nearest_features(q, st, 4, carry=["z"])
    got = {r["query_id"]: r["z"] for r in S.inverse_distance(near, "query_id", "z").collect()}
    assert got[1] == 10.0
    assert got[2] == pytest.approx((10 / 1 + 40 / 4) / (1 + 0.25))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 21, 500, 9000])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.34, 4.25, rng.lognormal(0, 3, n))  # one value holds a third of the rows
    probs = [0.0, 0.02, 1 / 3, 0.5, 0.95, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(7)
    q = ST.exact_quantiles(df, ["v"], probs).first()
    assert q["n"] == n
    assert q["q"] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_exact_quantiles_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 4000) ** 2, rng.normal(size=4000))]
    got = {r["g"]: r["q"] for r in ST.exact_quantiles(spark.createDataFrame(rows, "g int, v double"), ["v"], [0.1, 0.9], ["g"]).collect()}
    for g in {g for g, _ in rows}:
        assert got[g] == pytest.approx(list(np.quantile([v for h, v in rows if h == g], [0.1, 0.9])), rel=1e-12)


RING = [(130.0, 40.0), (560.0, 90.0), (640.0, 480.0), (380.0, 300.0), (90.0, 610.0)]


def shoelace(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def ring_table(spark, ring, **extra):
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    return spark.range(1).select(pts.alias("ring"), *[F.lit(v).alias(k) for k, v in extra.items()])


def test_clipped_cells_sum_to_the_polygon(spark):
    rows = G.polygon_overlap_per_cell(ring_table(spark, RING), 50.0).collect()
    assert sum(r["area"] for r in rows) == pytest.approx(shoelace(RING), abs=1e-6)
    assert max(r["area"] for r in rows) == pytest.approx(2500.0)


def test_holes_take_area_away(spark):
    hole = [(250.0, 150.0), (330.0, 150.0), (330.0, 230.0), (250.0, 230.0)]
    both = ring_table(spark, RING, hole=False).unionByName(ring_table(spark, hole, hole=True))
    total = sum(r["area"] for r in G.polygon_overlap_per_cell(both, 50.0).collect())
    assert total == pytest.approx(shoelace(RING) - 6400.0, abs=1e-6)


def test_generated_grid_keeps_ids_of_the_full_lattice(spark):
    rows = G.generate_grid(ring_table(spark, RING), 50.0).collect()
    ny = math.ceil((610.0 - 40.0) / 50.0)
    assert all(r["grid_id"] == r["ix"] * ny + r["iy"] + 1 for r in rows)
    assert sum(r["area_m2"] for r in rows) == pytest.approx(shoelace(RING), abs=1e-6)
    lattice = G.lattice(spark.createDataFrame([(90.0, 40.0, 640.0, 610.0)], "minx double, miny double, maxx double, maxy double"), 50.0)
    assert lattice.join(G.generate_grid(ring_table(spark, RING), 50.0), ["grid_id", "ix", "iy"]).count() == len(rows) < lattice.count()


def test_line_pieces_sum_to_the_line(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(c), float(e)) for a, b, c, e in rng.uniform(-900, 900, (60, 4))]
    rows += [(0.5, 3.25, 777.0, 3.25), (41.5, -300.0, 41.5, 300.0)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    total = S.line_length_per_cell(df).agg(F.sum("length")).first()[0]
    assert total == pytest.approx(sum(math.hypot(c - a, e - b) for a, b, c, e in rows), rel=1e-9)


def test_crossings_of_streets(spark):
    rows = [(1, 0.0, 55.0, 400.0, 55.0), (2, 120.0, 0.0, 120.0, 300.0), (3, 250.0, 60.0, 250.0, 300.0), (4, 0.0, 200.0, 400.0, 200.0)]
    df = spark.createDataFrame(rows, "segment_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r["x"], r["y"]) for r in S.crossings(df).collect()}
    assert got == {(120.0, 55.0), (120.0, 200.0), (250.0, 200.0)}


def test_network_nodes(spark):
    rows = [
        (1, 0.0, 0.0, 400.0, 400.0), (2, 0.0, 400.0, 400.0, 0.0),  # slanted, crossing at 200, 200
        (3, 100.0, 100.0, 100.0, 300.0),  # ends on both of them
        (4, 500.0, 0.0, 900.0, 0.0), (5, 600.0, 0.0, 800.0, 0.0),  # on each other: no junction
        (6, 700.0, 0.0, 700.0, 50.0),  # a T on those two
        (7, 900.0, 0.0, 950.0, 0.0),  # continues: two ways only
    ]
    df = spark.createDataFrame(rows, "segment_id long, x1 double, y1 double, x2 double, y2 double")
    for size in (100.0, 37.0):
        got = {(r["x"], r["y"]): r["pieces"] for r in S.network_nodes(df, size=size).collect()}
        assert got == {(200.0, 200.0): 4, (100.0, 100.0): 3, (100.0, 300.0): 3, (700.0, 0.0): 3}


def test_point_on_a_border_belongs_to_both_cells(spark):
    df = spark.createDataFrame([(100.0, 50.0)], "x double, y double")
    assert {(r["ix"], r["iy"]) for r in S.count_per_cell(df, "x", "y").collect()} == {(0, 0), (1, 0)}


def test_polygon_selection_falls_back_to_a_margin(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0025, 0.0), (3, 0.01, 0.0)], "grid_id long, lon double, lat double")
    tiny = [(0.0009, -0.0001), (0.0011, -0.0001), (0.0011, 0.0001)]
    assert {r["grid_id"] for r in S.cells_with_fallback(cells, "lon", "lat", tiny).collect()} == {1, 2}
    wide = [(-0.001, -0.001), (0.001, -0.001), (0.001, 0.001), (-0.001, 0.001)]
    assert {r["grid_id"] for r in S.cells_with_fallback(cells, "lon", "lat", wide).collect()} == {1}


def test_utm_round_trip_and_known_point(spark):
    pts = [(85.8245, 20.2961), (87.0, 0.0), (87.0, 45.0), (84.2, 45.0), (88.9, 12.5)]
    df = spark.createDataFrame(pts, "lon double, lat double").withColumn("u", fn.utm_forward("lon", "lat")).withColumn("b", fn.utm_inverse("u.x", "u.y"))
    for r in df.collect():
        assert r["b"]["x"] == pytest.approx(r["lon"], abs=1e-9) and r["b"]["y"] == pytest.approx(r["lat"], abs=1e-9)
    centre = df.where("lon = 87.0 and lat = 0.0").first()["u"]
    assert centre["x"] == pytest.approx(500000.0, abs=1e-6) and centre["y"] == pytest.approx(0.0, abs=1e-6)
    north = df.where("lon = 87.0 and lat = 45.0").first()["u"]  # the meridian arc to 45 degrees is 4984944.378 m; the scale is 0.9996
    assert north["x"] == pytest.approx(500000.0, abs=1e-6) and north["y"] == pytest.approx(4984944.378 * 0.9996, abs=1e-2)


def test_slope_of_a_plane_and_flat_ground(spark):
    rows = [(r, c, 2.0 * c + 1.0 * r, 5.0) for r in range(6) for c in range(7)]
    df = spark.createDataFrame(rows, "row long, col long, z double, flat double")
    s = RS.slope_aspect(df, "z", 1.0, 1.0).where("row between 1 and 4 and col between 1 and 5").collect()
    assert all(r["slope"] == pytest.approx(math.degrees(math.atan(math.hypot(2, 1)))) for r in s)
    flat = RS.pad_edges(RS.slope_aspect(df.select("row", "col", "flat"), "flat", 1.0, 1.0), ["slope", "aspect", "dzdx", "dzdy"]).collect()
    assert len(flat) == 42 and all(r["slope"] == 0.0 and r["aspect"] == -1.0 for r in flat)


def test_fill_nodata_follows_the_rolling_passes(spark):
    rng = np.random.default_rng(2)
    z = rng.uniform(0, 100, (7, 9))
    z[rng.random((7, 9)) < 0.6] = np.nan
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(7) for c in range(9)]
    got = RS.fill_nodata(spark.createDataFrame(rows, "row long, col long, z double"), "z").collect()
    want = z.copy()
    for _ in range(2):
        for shift, axis in ((1, 1), (-1, 1), (1, 0), (-1, 0)):
            want = np.where(np.isnan(want), np.roll(want, shift, axis=axis), want)
    want = np.where(np.isnan(want), np.nanmedian(want), want)
    for r in got:
        assert r["filled"] == pytest.approx(want[r["row"], r["col"]])


def test_circular_mean_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, 350.0), (1, 10.0), (2, None)], "k int, a double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(RS.circular_mean("a").alias("m")).collect()}
    assert min(got[1], 360 - got[1]) == pytest.approx(0.0, abs=1e-9) and got[2] == 0.0


def test_nearest_date_prefers_the_earlier_day_on_a_tie(spark):
    e = spark.createDataFrame([("2023-12-30",), ("2024-01-03",), ("2024-01-05",), ("2026-06-01",)], "d string").select(F.to_date("d").alias("date"))
    s = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-05", 5.0), ("2025-01-01", 9.0)], "d string, v double").select(F.to_date("d").alias("date"), "v")
    got = {str(r["date"]): r["nearest_v"] for r in SR.nearest_date_join(e, s, "date", "date").collect()}
    assert got == {"2023-12-30": 1.0, "2024-01-03": 1.0, "2024-01-05": 5.0, "2026-06-01": 9.0}


def test_date_folds_and_expanding_folds(spark):
    days = spark.range(11).select(F.expr("date_add(date'2024-01-01', int(id))").alias("date"))
    sizes = {r["fold"]: r["count"] for r in SR.date_folds(days, "date", 4).groupBy("fold").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 3, 3: 2}
    x = SR.expanding_folds(days, "date", 4)
    ends = x.groupBy("test_fold").agg(F.max(F.when(F.col("role") == "train", F.col("date"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("date"))).alias("b")).collect()
    assert len(ends) == 3 and all(r["a"] < r["b"] for r in ends)


@pytest.mark.parametrize("n,parts", [(3, {"train": 2, "test": 1}), (4, {"train": 2, "validation": 1, "test": 1}), (20, {"train": 14, "validation": 3, "test": 3})])
def test_split_by_date(spark, n, parts):
    days = spark.range(n).select(F.expr("date_add(date'2024-01-01', int(id))").alias("date"))
    assert {r["split"]: r["count"] for r in SR.split_by_date(days, "date").groupBy("split").count().collect()} == parts


def test_keep_first_combines_a_hot_key(spark):
    rows = [(1, i) for i in range(500)] + [(k, k) for k in range(2, 50)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r["k"]: r["v"] for r in KY.keep_first(df, ["k"], ["v"]).collect()}
    assert got[1] == 0 and len(got) == 49
    plan = KY.keep_first(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = KY.top_n(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_histogram_of_a_constant(spark):
    h = ST.histogram(spark.createDataFrame([(5.0,)] * 4, "v double"), "v", 20).collect()
    assert sum(r["n"] for r in h) == 4 and len(h) == 20


def test_sparse_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, 5.0)], "id int, a double, b double")
    assert ST.drop_sparse_columns(df, ["a", "b"], 50.0).columns == ["id", "a"]


def test_clusters_and_an_outlier_leave_few_pairs(spark):
    """Two tight crowds, one of them on a single spot, thin country and a point very far away: a query meets few spots."""
    import random

    from thermogrid.operators.spatial import _box_bounds, _open_leaves, _packed_tree

    draw = random.Random(8)
    points = [(500 + draw.gauss(0, 0.01), 500 + draw.gauss(0, 0.01)) for _ in range(3000)] + [(200.0, 300.0)] * 2000
    points += [(draw.uniform(0, 1000), draw.uniform(0, 1000)) for _ in range(1000)] + [(1e9, -1e9)]
    queries = [(i, *points[draw.randrange(len(points))]) for i in range(40)] + [(100, 500.0, 500.0), (101, 200.1, 300.0), (102, 5e8, 0.0)]
    features = spark.createDataFrame([(i, x, y, x, y) for i, (x, y) in enumerate(points)], "feature_id int, x1 double, y1 double, x2 double, y2 double")
    q = spark.createDataFrame(queries, "query_id int, qx double, qy double")
    for k in (1, 5):
        placed, levels = _packed_tree(features, "feature_id", [], k, None)
        met = _open_leaves(q, placed, levels, k, "query_id", _box_bounds).join(placed, "node").groupBy("query_id").count()
        assert max(r["count"] for r in met.collect()) <= 160
        got = {(r.query_id, r["rank"]): (r.feature_id, r.distance) for r in S.nearest_features(q, features, k).collect()}
        for i, qx, qy in queries:
            want = sorted((((x - qx) ** 2 + (y - qy) ** 2) ** 0.5, f) for f, (x, y) in enumerate(points))[:k]
            assert [got[i, r + 1][0] for r in range(k)] == [f for _, f in want]
