"""Scenarios, feature table, models and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thermogrid import constants as K, functions as fn
from thermogrid.plans import feature_table as T, models as MD, scenario as SC, temporal as TP
from thermogrid.streaming import jobs as J, observations as O, snapshot as SN


@pytest.fixture(scope="module")
def cells(spark):
    k = F.col("id")
    return spark.range(40).select(
        k.alias("grid_id"), (k * 2.0).alias("green_cover"), (k / 50.0).alias("mean_ndvi"), (k * 1.0).alias("tree_count"), (k * 1.5).alias("tree_density"),
        (k / 40.0).alias("impervious_ratio"), (k * 2.0).alias("building_coverage_pct"), (k / 40.0).alias("hvi"), (k / 40.0).alias("veg_cooling"),
        (k * 2.0).alias("green_space_pct"), (k * 1.0).alias("green_to_built"), (k * 100.0).alias("dist_to_park"), (k * 1.0).alias("veg_density"))


def test_kinds_and_bounds(spark, cells):
    out = SC.perturb(cells, {"green_cover": ("add", 50.0), "tree_count": ("mul", 2.0), "mean_ndvi": ("min", 0.3), "dist_to_park": ("max", 500.0), "nothing": ("add", 1.0)})
    r = out.where("grid_id = 39").first()
    assert (r["green_cover"], r["tree_count"], r["mean_ndvi"]) == (100.0, 78.0, 0.3)
    assert out.where("grid_id = 0").first()["dist_to_park"] == 500.0
    assert "nothing" not in out.columns
    with pytest.raises(ValueError):
        SC.perturb(cells, {"green_cover": ("square", 2.0)})


def test_ten_points_of_green_cool_half_a_degree(spark, cells):
    r = SC.run_scenarios(cells.where("green_cover <= 90"), SC.linear_scorer(), {"green": {"green_cover": ("add", 10.0)}})
    assert all(x["delta_lst"] == pytest.approx(-0.5) for x in r.collect())


def test_builders(spark):
    assert SC.intervention("tree_planting", 50) == {f: (k, pytest.approx(v)) for f, (k, v) in K.SCENARIOS["increase_trees"].items()}
    assert SC.intervention("green_corridor", 1000)["dist_to_park"] == ("mul", 0.0)
    assert SC.ratio_scaled(K.SCENARIOS["increase_green_10"])["impervious_ratio"] == ("add", -0.05)
    for bad in (lambda: SC.intervention("tree_planting", -1), lambda: SC.intervention("cool_roof", 101), lambda: SC.intervention("green_corridor", -5)):
        with pytest.raises(ValueError):
            bad()


def test_area_scenario_leaves_the_rest_alone(spark, cells):
    r = SC.run_area_scenario(cells, SC.linear_scorer(), K.SCENARIOS["increase_green_20"], F.col("grid_id") < 10)
    v = SC.validate_area(r).first()
    assert v["validation_passed"] and v["affected_cells"] == 10 and v["outside_unchanged"] == 30


def test_expand_needs_no_join(spark, cells):
    plan = SC.expand(cells, SC.all_scenarios())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_python_and_column_scorer_agree(spark, cells):
    def load():
        return lambda b: 35.0 - 0.05 * b["green_cover"]

    a = SC.linear_scorer({"green_cover": -0.05})(cells).withColumnRenamed("predicted_lst", "a")
    assert SC.pandas_scorer(load, ["green_cover"])(a).where("abs(a - predicted_lst) > 1e-12").count() == 0


def test_subindex_gaps_and_top_band(spark):
    df = spark.createDataFrame([(30.5,), (30.0,), (502.0,), (503.0,)], "c double").select(fn.aqi_subindex("c", "pm25").alias("i"), fn.aqi_subindex("c", "pm25", open_top=True).alias("j"))
    assert [(r["i"], r["j"]) for r in df.collect()] == [(None, None), (50.0, 50.0), (500.0, 500.0), (500.0, None)]


def test_two_category_rules_differ_between_integers(spark):
    r = spark.createDataFrame([(50.5,)], "a double").select(fn.aqi_category("a").alias("x"), fn.aqi_category_code("a").alias("y")).first()
    assert (r["x"], r["y"]) == ("Satisfactory", 1)


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in df.select(fn.finite("v")).collect()] == [None, None, 2.0]
    assert [r[0] for r in df.select(fn.clip01(fn.finite("v"))).collect()] == [None, None, 1.0]


def test_validation_and_encoding(spark):
    df = spark.createDataFrame([(1, 1.0, 3), (2, None, 5), (3, float("inf"), 5)], "id int, a double, c int")
    good, bad = T.split_valid(df, ["a", "c"])
    assert good.count() == 1 and {r["reasons"][0] for r in bad.collect()} == {"a missing", "a not finite"}
    with pytest.raises(ValueError):
        T.validate_rows(df, ["zz"])
    fitted = T.fit_preprocessor(df.where("id < 3"), ["a"], ["c"])
    out = {r["id"]: (r["a"], r["c"]) for r in T.apply_preprocessor(spark.createDataFrame([(7, None, 9)], "id int, a double, c int"), fitted).collect()}
    assert out[7] == (1.0, 0.0)


def test_clean_dataset(spark):
    rows = [(1, 1.0, 2.0, None, 1), (2, 1.0, 2.0, None, 1), (3, None, 4.0, None, 2), (4, 3.0, 6.0, 1.0, 2)]
    out = T.clean_dataset(spark.createDataFrame(rows, "id int, a double, b double, sparse double, cls int"), "id", ["a", "b", "sparse"], ["cls"])
    assert "sparse" not in out.columns
    assert sorted((r["id"], r["a"]) for r in out.collect()) == [(1, 1.0), (3, 2.0), (4, 3.0)]


def test_folds_are_disjoint_and_repeatable(spark):
    ids = spark.range(5000).withColumnRenamed("id", "grid_id")
    a = MD.hash_folds(ids, "grid_id", 5)
    b = MD.hash_folds(ids.repartition(13), "grid_id", 5)
    assert a.exceptAll(b).count() == 0
    sizes = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 850
    share = MD.hash_split(ids, "grid_id").where("is_test").count() / 5000
    assert 0.17 < share < 0.23
    assert 500 <= MD.early_stopping_slice(ids, "grid_id").where("validation").count() <= 520
    assert MD.fixed_sample(ids, "grid_id", 50).exceptAll(MD.fixed_sample(ids.repartition(7), "grid_id", 50)).count() == 0


def test_models_learn_a_linear_target(spark):
    df = spark.range(800).select(F.col("id").alias("grid_id"), (F.col("id") % 37 * 1.0).alias("a"), (F.col("id") % 11 * 1.0).alias("b")).withColumn("y", 3 * F.col("a") - F.col("b") + 20)
    board = MD.leaderboard(df.where("grid_id % 5 > 0"), df.where("grid_id % 5 = 0"), ["a", "b"], "y", {"linear": MD.linear("y"), "forest": MD.random_forest("y", 8, 6)}).collect()
    assert [r["rank"] for r in board] == [1, 2] and board[0]["model"] == "linear" and min(r["r2"] for r in board) > 0.8
    imp = MD.baseline_importance(df, ["a", "b"], "y", 8, 6).collect()
    assert imp[0]["feature"] == "a" and sum(r["importance_pct"] for r in imp) == pytest.approx(100.0)
    scored = SC.model_scorer(MD.fit(df, ["a", "b"], MD.linear("y")))(df)
    assert scored.where("abs(predicted_lst - y) > 0.01").count() == 0


def test_scene_with_few_valid_cells_is_skipped(spark):
    rows = [("good", i, 30.0 if i < 5 else None) for i in range(10)] + [("bad", i, 30.0 if i < 2 else None) for i in range(10)]
    obs = spark.createDataFrame(rows, "scene_id string, grid_id int, lst_c double")
    assert {r["scene_id"] for r in TP.usable_observations(obs).select("scene_id").distinct().collect()} == {"good"}


# --- streams -----------------------------------------------------------------------------------------


def write_rounds(spark, folder, rounds):
    for i, rows in enumerate(rounds):
        spark.createDataFrame(rows, "event_id long, source string, at string, value double").select(
            "event_id", "source", F.to_timestamp("at").alias("observed_at"), "value").coalesce(1).write.mode("append").parquet(str(folder))


ROUNDS = [
    [(1, "a", "2024-01-01 00:00:00", 1.0), (2, "a", "2024-01-01 00:04:59", 2.0), (3, "b", "2024-01-01 00:00:10", 5.0)],
    [(4, "a", "2024-01-01 00:20:00", 3.0), (5, "b", "2024-01-02 12:00:00", 6.0)],
    [(6, "a", "2024-01-05 00:00:00", 4.0), (7, "b", "2024-01-05 00:00:00", 7.0)],
]


def test_streams_equal_their_static_twins(spark, tmp_path):
    write_rounds(spark, tmp_path / "in", ROUNDS)
    static = spark.read.parquet(str(tmp_path / "in"))
    stream = J.file_stream(spark, str(tmp_path / "in"), static.schema, files_per_trigger=1)

    latest = SN.latest_readings(stream, ["event_id", "value"], "event_id")
    got = J.newest_version(J.each_batch_and_read(latest, "t", lambda b: b, base=str(tmp_path / "latest")), ["source"])
    want = SN.latest_readings(static, ["event_id", "value"], "event_id")
    assert sorted(map(tuple, got.select("source", "event_id").collect())) == sorted(map(tuple, want.select("source", "event_id").collect()))

    roll = J.each_batch_and_read(O.daily_rollup(stream, "source", "event_id", "30 days"), "t", lambda b: b, base=str(tmp_path / "roll"))
    assert J.newest_version(roll, ["date", "source", "event_id"]).count() == O.daily_rollup(static, "source", "event_id", None).count()

    # Append mode lets a span out once the watermark has passed its end, so the open ones at the end are absent.
    spans = J.append_and_read(O.live_periods(stream, 300, "1 hour"), "t", str(tmp_path / "spans"))
    twin = O.live_periods(static, 300)
    assert spans.exceptAll(twin).count() == 0
    assert twin.exceptAll(spans).count() == 2
    first = twin.where("source = 'a'").orderBy("live_from").first()
    assert first["readings"] == 2 and str(first["expires_at"]) == "2024-01-01 00:09:59"


def test_a_drained_stream_reads_nothing_twice(spark, tmp_path):
    write_rounds(spark, tmp_path / "in", ROUNDS[:2])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):
        out = J.append_and_read(J.file_stream(spark, str(tmp_path / "in"), schema), "t", str(tmp_path / "run"))
        assert out.count() == 5


def test_weather_payload(spark):
    body = '{"main": {"temp": 31.5, "humidity": 70}, "wind": {"speed": 5.0}, "dt": 1700000000, "sys": {"sunrise": 1699990000, "sunset": 1700020000}}'
    rows = spark.createDataFrame([("w", body), ("w", '{"main": {}, "dt": 5}')], "source string, payload string")
    (r,) = O.parse_weather(rows, "payload").collect()
    assert (r["wind_speed_kmh"], r["rain_mm"], r["is_day"], r["pressure"]) == (18.0, 0.0, True, None)


def test_freshness_and_feed_state(spark):
    latest = spark.sql("select 'w' source, timestamp'2024-01-01 00:00:00' observed_at union all select 's', timestamp'2023-01-01 00:00:00'")
    expected = spark.createDataFrame([("w", "live"), ("s", "satellite"), ("gis", "static"), ("air", "live")], "source string, kind string")
    st = SN.freshness(latest, expected, spark.sql("select timestamp'2024-01-01 00:05:00' at"))
    assert {r["source"]: r["status"] for r in st.collect()} == {"w": "LIVE", "s": "LATEST_OBSERVATION", "gis": "STATIC", "air": "UNAVAILABLE"}
    state = SN.feed_status(st, spark.sql("select 31.0d prediction")).first()
    assert (state["missing_sources"], state["fallback_used"], state["state"]) == (["air"], False, "partial")
    assert SN.feed_status(st, spark.sql("select cast(null as double) prediction")).first()["state"] == "model_error"


def test_weather_of_two_months_stays_apart(spark, tmp_path):
    """The fifth of January and the fifth of February are two days."""
    from thermogrid.catalog.views import Data

    rows = [(0, "click", "2024-01-05 10:00:00", 10.0), (1, "click", "2024-02-05 10:00:00", 30.0), (2, "view", "2024-02-05 10:00:00", 50.0), (3, "view", "2025-02-05 10:00:00", 90.0)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = Data(spark, str(tmp_path)).weather_daily.orderBy("site", "date").collect()
    assert [(r.site, r.n) for r in got] == [("click", 1), ("click", 1), ("view", 1), ("view", 1)]
    assert [str(r.date) for r in got if r.site == "click"] == ["2024-01-05", "2024-02-05"]


def test_nearest_date_stays_within_its_station(spark):
    from thermogrid.operators import series as SR

    events = spark.createDataFrame([("a", "2024-03-01"), ("b", "2024-03-01"), ("c", "2024-03-01")], "site string, date string").withColumn("date", F.to_date("date"))
    series = spark.createDataFrame([("a", "2023-12-31", 1.0), ("b", "2024-02-20", 2.0), ("b", "2024-03-09", 3.0), ("a", "2025-01-01", 4.0)], "site string, date string, v double").withColumn("date", F.to_date("date"))
    got = SR.nearest_date_join(events, series, "date", "date", by=["site"]).collect()
    assert {(r.site, r.nearest_v) for r in got} == {("a", 1.0), ("b", 3.0)}


@pytest.mark.parametrize("kind,value,want", [("add", 5.0, [15.0, None]), ("mul", 0.5, [5.0, None]), ("min", 4.0, [4.0, None]), ("max", 12.0, [12.0, None])])
def test_every_kind_of_change(spark, kind, value, want):
    df = spark.createDataFrame([(1, 10.0), (2, None)], "i int, z double")
    got = df.select("i", SC.perturbed("z", kind, value).alias("z"), SC.changed("z", F.lit(kind), F.lit(value)).alias("y")).orderBy("i").collect()
    assert [r.z for r in got] == want == [r.y for r in got]
    with pytest.raises(ValueError):
        SC.perturbed("z", "div", 1.0)
