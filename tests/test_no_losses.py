"""Nothing is dropped in silence: caps, late readings, odd lines, far latitudes."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from thermogrid.operators import spatial as S, stats as ST
from thermogrid.plans.city import nearest_cells
from thermogrid.sources import readers as R
from thermogrid.streaming import jobs as J, snapshot as SN


def metres(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("lat", [-72.0, 0.0, 20.0, 60.0, 84.0])
def test_nearest_cell_at_any_latitude(spark, lat):
    rng = random.Random(int(lat))
    cells = [(i, 10 + rng.random() * 0.2, lat + rng.random() * 0.1) for i in range(400)] + [(400, 40.0, lat - 3)]
    points = [(i, 10 + rng.random() * 0.2, lat + rng.random() * 0.1) for i in range(60)]
    got = nearest_cells(spark.createDataFrame(points, "point_id int, lon double, lat double"), spark.createDataFrame(cells, "grid_id int, lon double, lat double"), max_km=1e5)
    found = {r.point_id: r for r in got.collect()}
    for i, x, y in points:
        best = min(metres((x, y), (a, b)) for _, a, b in cells)
        assert found[i].distance_m == pytest.approx(best, abs=1e-3)


def test_sphere_bounds_hold(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        x0, y0 = rng.uniform(-180, 170), rng.uniform(-89, 80)
        x1, y1 = x0 + rng.uniform(0, 10), y0 + rng.uniform(0, 9)
        rows.append((rng.uniform(-180, 180), rng.uniform(-90, 90), x0, y0, x1, y1))
    df = spark.createDataFrame(rows, "qx double, qy double, bx0 double, by0 double, bx1 double, by1 double")
    low, _, high = S.sphere_bounds(F.col("qx"), F.col("qy"))
    for r in df.select("*", low.alias("low"), high.alias("high")).collect():
        for _ in range(30):
            d = metres((r.qx, r.qy), (rng.uniform(r.bx0, r.bx1), rng.uniform(r.by0, r.by1)))
            assert r.low - 1e-3 <= d <= r.high + 1e-3


def test_late_snapshots_come_out(spark, tmp_path):
    rounds = [("a", "2024-01-05 00:00:00"), ("b", "2024-01-06 00:00:00"), ("c", "2024-01-01 00:00:00"), ("a", "2024-01-04 00:00:00")]
    for k, (name, at) in enumerate(rounds):
        df = spark.createDataFrame([(name, at)], "snapshot_id string, at string").select("snapshot_id", F.to_timestamp("at").alias("observed_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = df.schema
    stream = J.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    changes = J.each_batch_and_read(SN.change_feed(stream), "t", lambda b: b, base=str(tmp_path / "run"))
    latest = {r.snapshot_id: (str(r.first_seen), str(r.last_seen)) for r in J.newest_version(changes, ["snapshot_id"]).collect()}
    assert set(latest) == {"a", "b", "c"} and latest["a"] == ("2024-01-04 00:00:00", "2024-01-05 00:00:00")


def test_geojson_lines_and_documents(spark, tmp_path):
    one = '{"type": "Feature", "properties": {"k": 1}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}'
    none = '{"type": "Feature", "properties": {"k": 2}, "geometry": null}'
    lines = tmp_path / "lines.geojson"
    lines.write_text('{"type": "FeatureCollection", "features": [\n' + one + ",\n" + none + "\n]}\n")
    got = {r.k: r.geom_type for r in R.read_geojson(spark, str(lines), "k: bigint").collect()}
    assert got == {1: "Point", 2: None}
    for text in ('{"type": "FeatureCollection", "features": [' + one + "," + none + "]}", '{\n"type": "FeatureCollection",\n"features": [\n' + one + ",\n" + none + "\n]\n}"):
        doc = tmp_path / "doc.geojson"
        doc.write_text(text)
        assert {r.k: r.geom_type for r in R.read_geojson_document(spark, str(doc), "k: bigint").collect()} == got
    broken = tmp_path / "broken.geojson"
    broken.write_text(one + "\n{ not a feature\n")
    with pytest.raises(Exception, match="not a GeoJSON feature"):
        R.read_geojson(spark, str(broken), "k: bigint").collect()


def test_box_without_a_limit(spark):
    cells = spark.range(3000).selectExpr("id AS grid_id", "0.5D AS lon", "0.5D AS lat")
    assert R.bounding_box(cells, 0, 0, 1, 1, (0.1, 0.1)).count() == 3000
    assert R.bounding_box(cells, 0, 0, 1, 1, (0.1, 0.1), limit=7).count() == 7
    with pytest.raises(ValueError):
        R.bounding_box(cells, 0, 0, 1, 1, (0.1, 0.1), limit=0)


@pytest.mark.parametrize("shape", ["uniform", "copies", "clustered", "tiny"])
def test_exact_quantiles(spark, shape):
    import numpy as np

    draw = np.random.default_rng(1)
    v = {"uniform": draw.random(40_000), "copies": draw.integers(0, 5, 40_000) * 1.0, "clustered": np.concatenate([draw.random(20_000) * 1e-9, draw.random(20_000) * 1e9]), "tiny": np.array([3.0, 1.0, 2.0])}[shape]
    df = spark.createDataFrame([(float(x), int(i % 2)) for i, x in enumerate(v)], "v double, g int")
    probs = [0.9, 0.0, 0.5, 0.25, 1.0, 1 / 3]
    (row,) = ST.exact_quantiles(df, ["v"], probs).collect()
    assert row.q == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12) and row.n == len(v)
    for r in ST.exact_quantiles(df, ["v"], probs, by=["g"]).collect():
        assert r.q == pytest.approx(np.quantile(v[r.g :: 2], probs).tolist(), rel=1e-12)


def test_ranks_are_never_sorted_in_one_task_per_quantile(spark):
    df = spark.range(1000).selectExpr("CAST(id AS double) AS v")
    plan = ST.exact_quantiles(df, ["v"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("slice" in line for line in windows)


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from thermogrid import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        session.shared_folder(Session())
