"""ST1-ST9: streams over the events table, run to completion and compared with their static twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid.catalog.registry import query
from thermogrid.functions import round_even
from thermogrid.plans import scenario as SC
from thermogrid.session import scratch_path
from thermogrid.streaming import jobs as J, liveness as L, observations as O, snapshot as SN

LIVE_WEIGHTS = {"green_cover": -0.05, "mean_aqi": 0.01}


def observation_stream(d, batches: int = 1):
    """Readings as a stream. With several batches, each one holds readings of all times, so most batches bring late ones."""
    if batches == 1:
        raw = J.file_stream(d.spark, d.folder, d.events.schema, "events.parquet")
    else:
        path = scratch_path(d.spark, "event-batches")
        d.events.repartition(batches, F.pmod("event_id", F.lit(batches))).write.parquet(path)
        raw = J.file_stream(d.spark, path, d.events.schema, files_per_trigger=1)
    return raw.select("event_id", F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("observed_at"), "value", "props", "user_id")


def observed(d):
    return d.observations.withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("observation_stream_ST1", """
    SELECT event_id, source, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AND value IS NOT NULL AS complete FROM observations""")
def _(d):
    parsed = O.parse_observations(observation_stream(d), "props", "k bigint").select("event_id", "source", "k", "complete")
    return J.append_and_read(parsed, "observations")


LATEST_SQL = "SELECT source, event_id, value, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY observed_at DESC, event_id DESC) AS rn FROM observations) q WHERE rn = 1"


@query("latest_reading_ST2", f"WITH l AS ({LATEST_SQL}) SELECT source, event_id, R6(value) AS value FROM l")
def _(d):
    latest = SN.latest_readings(observation_stream(d), ["event_id", "value"], "event_id")
    changes = J.each_batch_and_read(latest, "latest", lambda b: b, "update")
    return J.newest_version(changes, ["source"]).select("source", "event_id", round_even("value", 6).alias("value"))


@query("live_periods_ST3", """
    WITH g AS (SELECT source, observed_at, CASE WHEN epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY source ORDER BY observed_at)) < 300000000 THEN 0 ELSE 1 END AS starts FROM observations),
    s AS (SELECT source, observed_at, sum(starts) OVER (PARTITION BY source ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT source, CAST(epoch_us(min(observed_at)) AS BIGINT) AS live_from_us, CAST(epoch_us(max(observed_at)) + 300000000 AS BIGINT) AS expires_us, count(*) AS readings FROM s GROUP BY source, k""")
def _(d):
    p = O.live_periods(observed(d))
    return p.select("source", F.unix_micros("live_from").alias("live_from_us"), F.unix_micros("expires_at").alias("expires_us"), "readings")


def payload_stream(d, label, payload):
    """Readings as provider payloads, streamed in two batches."""
    path = scratch_path(d.spark, label)
    d.events.select("event_id", payload.alias("payload")).repartition(2, "event_id").write.parquet(path)
    return J.file_stream(d.spark, path, "event_id bigint, payload string", files_per_trigger=1)


@query("weather_payloads_ST1b", """
    SELECT event_id, R6(value * 0.3e0) AS temperature, R6(value / 7.0e0) AS wind_speed, R6(value / 7.0e0 * 3.6e0) AS wind_speed_kmh,
      CASE WHEN event_id % 3 = 0 THEN R6(value / 11.0e0) ELSE 0.0e0 END AS rain_mm, event_id % 2 = 0 AS is_day
    FROM events WHERE value IS NOT NULL AND event_id % 13 <> 0""")
def _(d):
    i, v = F.col("event_id"), F.col("value")
    rain = F.when(i % 3 == 0, F.create_map(F.lit("1h"), v / 11.0))
    sun = F.struct(F.when(i % 2 == 0, 0).otherwise(5_000_000_000).cast("long").alias("sunrise"), F.lit(6_000_000_000).alias("sunset"))
    payload = F.to_json(F.struct(
        F.struct(F.when(i % 13 != 0, v * 0.3).alias("temp"), F.lit(50.0).alias("humidity")).alias("main"), F.struct((v / 7.0).alias("speed")).alias("wind"),
        rain.alias("rain"), (F.lit(1_700_000_000) + i).cast("long").alias("dt"), sun.alias("sys")))
    parsed = J.append_and_read(O.parse_weather(payload_stream(d, "weather-payloads", payload), "payload"), "weather")
    return parsed.select("event_id", *[round_even(c, 6).alias(c) for c in ("temperature", "wind_speed", "wind_speed_kmh", "rain_mm")], "is_day")


@query("air_payloads_ST1c", """
    SELECT event_id, k AS hour, CAST(1 + event_id % 5 AS INT) AS aqi, R6(value + k) AS pm2_5, CASE WHEN k = 1 THEN R6(value * 2.0e0) END AS no2
    FROM events, (VALUES (0), (1)) t(k) WHERE value IS NOT NULL""")
def _(d):
    i, v = F.col("event_id"), F.col("value")
    reading = lambda k: F.struct(
        F.lit(3600 * k).cast("long").alias("dt"), F.struct((1 + i % 5).alias("aqi")).alias("main"),
        F.struct((v + k).alias("pm2_5"), F.when(F.lit(k == 1), v * 2.0).alias("no2")).alias("components"))
    payload = F.to_json(F.struct(F.array(reading(0), reading(1)).alias("list")))
    parsed = J.append_and_read(O.parse_air_quality(payload_stream(d, "air-payloads", payload).where("payload like '%pm2_5%'"), "payload"), "air")
    return parsed.select("event_id", (F.unix_seconds("observed_at") / 3600).cast("int").alias("hour"), "aqi", *[round_even(c, 6).alias(c) for c in ("pm2_5", "no2")])


EXPECTED = """(VALUES ('click', 'live'), ('view', 'satellite'), ('error', 'live'), ('purchase', 'live'), ('dem', 'static'), ('lidar', 'live')) e(source, kind)"""
STATUS_SQL = f"""
    WITH l AS ({LATEST_SQL}), now AS (SELECT max(observed_at) AS at FROM observations),
    st AS (SELECT e.source, e.kind, CASE WHEN e.kind = 'static' THEN 'STATIC' WHEN l.observed_at IS NULL THEN 'UNAVAILABLE' WHEN e.kind = 'satellite' THEN 'LATEST_OBSERVATION'
      WHEN epoch_us(now.at) - epoch_us(l.observed_at) <= 300000000 THEN 'LIVE' ELSE 'UNAVAILABLE' END AS status FROM {EXPECTED} CROSS JOIN now LEFT JOIN l ON l.source = e.source)
"""


def expected_sources(d):
    rows = [("click", "live"), ("view", "satellite"), ("error", "live"), ("purchase", "live"), ("dem", "static"), ("lidar", "live")]
    return d.spark.createDataFrame(rows, "source string, kind string")


def statuses(d):
    obs = observed(d)
    return SN.freshness(SN.latest_readings(obs, ["event_id"], "event_id"), expected_sources(d), obs.agg(F.max("observed_at").alias("at")))


@query("freshness_status_ST4", STATUS_SQL + "SELECT source, kind, status FROM st")
def _(d):
    return statuses(d).select("source", "kind", "status")


#: Readings in a batch, about, so that what a batch holds does not grow with the table.
BATCH_READINGS = 1_000_000


def timed_stream(d, seconds_on: int, batches: int = 3):
    """Readings in order of time, a file a batch, and then only a clock that goes on for so many seconds after the last reading.

    A stretch of time is one file: of several, those that a later batch brought would come too late. There are more stretches of
    larger tables.
    """
    path = scratch_path(d.spark, "timed-events")
    rows = observed(d).select("source", "observed_at")
    low, high, n = rows.agg(F.min("observed_at"), F.max("observed_at"), F.count(F.lit(1))).first()
    batches = max(batches, -(-n // BATCH_READINGS))
    share = F.least(F.floor((F.unix_micros("observed_at") - F.unix_micros(F.lit(low))) * batches / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1)), F.lit(batches - 1))
    for k in range(batches):
        rows.where(share == k).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    ticks = d.spark.range(1).select(F.lit(None).cast("string").alias("source"), (F.lit(high) + F.make_dt_interval(secs=F.lit(seconds_on + LATE))).alias("observed_at"))
    for k in range(2):  # the time that a batch brings holds from the next one on
        ticks.write.mode("append").parquet(f"{path}/{batches + k}")
    return d.spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


#: Seconds that readings may come out of order.
LATE = 10


@query("status_changes_ST3b", """
    WITH g AS (SELECT source, observed_at, CASE WHEN epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY source ORDER BY observed_at)) < 300000000 THEN 0 ELSE 1 END AS starts FROM observations),
    s AS (SELECT source, observed_at, sum(starts) OVER (PARTITION BY source ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS k FROM g),
    p AS (SELECT source, epoch_us(min(observed_at)) AS first, epoch_us(max(observed_at)) AS last, count(*) AS n FROM s GROUP BY source, k)
    SELECT source, 'LIVE' AS status, CAST(first AS BIGINT) AS at_us, CAST(0 AS BIGINT) AS readings FROM p
    UNION ALL SELECT source, 'UNAVAILABLE', CAST(last + 300000000 AS BIGINT), n FROM p""")
def _(d):
    """Every change of every source, from timers: an hour after the last reading all have expired, without a reading."""
    changes = J.append_and_read(L.status_changes(timed_stream(d, 3600), late=f"{LATE} seconds"), "changes")
    return changes.select("source", "status", F.unix_micros("at").alias("at_us"), "readings")


@query("status_by_timer_ST4b", f"""
    WITH l AS ({LATEST_SQL}), now AS (SELECT max(observed_at) + INTERVAL 100 SECOND AS at FROM observations)
    SELECT e.source, e.kind, CASE WHEN e.kind = 'static' THEN 'STATIC' WHEN l.observed_at IS NULL THEN 'UNAVAILABLE' WHEN e.kind = 'satellite' THEN 'LATEST_OBSERVATION'
      WHEN epoch_us(now.at) - epoch_us(l.observed_at) < 300000000 THEN 'LIVE' ELSE 'UNAVAILABLE' END AS status FROM {EXPECTED} CROSS JOIN now LEFT JOIN l ON l.source = e.source""")
def _(d):
    """What the stream says a hundred seconds after the last reading."""
    base = L.run_feed(L.status_changes(timed_stream(d, 100), late=f"{LATE} seconds"), expected_sources(d), "feed")
    changes = d.spark.read.schema(L.TRANSITIONS).parquet(f"{base}/changes")
    return L.current_status(changes, expected_sources(d))


@query("snapshot_history_ST5", """
    SELECT concat('snap_', strftime(date_trunc('hour', observed_at), '%Y_%m_%d_%H%M%S'), '_000') AS snapshot_id, count(*) AS readings FROM observations GROUP BY 1""")
def _(d):
    """The stored history of a stream over several batches: the last state of every snapshot."""
    snaps = observation_stream(d, 4).groupBy(SN.snapshot_id(F.date_trunc("hour", "observed_at")).alias("snapshot_id")).agg(F.count(F.lit(1)).alias("readings"))
    return J.newest_version(J.each_batch_and_read(snaps, "history", lambda b: b, "update"), ["snapshot_id"]).select("snapshot_id", "readings")


@query("newest_snapshots_ST5b", """
    SELECT concat('snap_', strftime(date_trunc('hour', observed_at), '%Y_%m_%d_%H%M%S'), '_000') AS snapshot_id, count(*) AS readings FROM observations GROUP BY 1 ORDER BY 1 DESC LIMIT 100""")
def _(d):
    snaps = d.observations.groupBy(SN.snapshot_id(F.date_trunc("hour", "observed_at")).alias("snapshot_id")).agg(F.count(F.lit(1)).alias("readings"))
    return SN.newest_snapshots(snaps, 100)


@query("change_feed_ST6", "SELECT DISTINCT concat('snap_', strftime(date_trunc('minute', observed_at), '%Y_%m_%d_%H%M%S'), '_000') AS snapshot_id FROM observations")
def _(d):
    s = observation_stream(d, 4).select("observed_at", SN.snapshot_id(F.date_trunc("minute", "observed_at")).alias("snapshot_id"))
    changes = J.each_batch_and_read(SN.change_feed(s), "changes", lambda b: b, "update")
    return J.newest_version(changes, ["snapshot_id"]).select("snapshot_id")


_LIVE_SCORE = "35.0e0 - 0.05e0 * green_cover + 0.01e0 * v"


@query("live_grid_scoring_ST7", f"""
    WITH l AS (SELECT arg_max(value, (observed_at, event_id)) AS v FROM observations)
    SELECT count(*) AS cells, R6(avg({_LIVE_SCORE})) AS mean_lst, R6(min({_LIVE_SCORE})) AS min_lst, R6(max({_LIVE_SCORE})) AS max_lst FROM cells, l""")
def _(d):
    """The newest reading of any source on every cell; each batch that brings one scores the grid anew."""
    cells = d.cells.select("grid_id", "green_cover", "mean_aqi")
    newest = SN.newest_reading(observation_stream(d, 4), ["value"], "event_id")
    scorer = SC.linear_scorer(LIVE_WEIGHTS)
    score = lambda b: SN.score_live(cells, b.select(F.col("value").alias("mean_aqi")), ["mean_aqi"], scorer)
    runs = J.each_batch_and_read(newest, "scores", score, "update")
    last = J.newest_version(runs.withColumn("_k", F.lit(1)), ["_k"])
    return last.select("cells", *[round_even(c, 6).alias(c) for c in ("mean_lst", "min_lst", "max_lst")])


@query("feed_status_ST8", STATUS_SQL + """
    SELECT string_agg(CASE WHEN status = 'UNAVAILABLE' THEN source END, ',' ORDER BY source) AS missing_sources, bool_or(kind = 'satellite' AND status = 'UNAVAILABLE') AS fallback_used,
      CASE WHEN count(*) FILTER (status = 'UNAVAILABLE') = 0 THEN 'available' ELSE 'partial' END AS state FROM st""")
def _(d):
    predicted = SC.linear_scorer()(d.cells).agg(F.avg("predicted_lst").alias("prediction"))
    out = SN.feed_status(statuses(d), predicted)
    return out.select(F.array_join("missing_sources", ",").alias("missing_sources"), "fallback_used", "state")


@query("daily_rollup_ST9", "SELECT CAST(observed_at AS DATE) AS date, user_id, source, R6(avg(value)) AS mean_value, count(value) AS n FROM observations GROUP BY 1, 2, 3")
def _(d):
    roll = O.daily_rollup(observation_stream(d, 4), "user_id", "source", late=None)
    changes = J.each_batch_and_read(roll, "rollup", lambda b: b, "update")
    return J.newest_version(changes, ["date", "user_id", "source"]).select("date", "user_id", "source", round_even("mean_value", 6).alias("mean_value"), "n")
