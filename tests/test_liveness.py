"""Sources that fall silent: timers on a stream against spans worked out by hand and from the table."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from thermogrid.session import scratch_path
from thermogrid.streaming import jobs as J, liveness as L

START = dt.datetime(2024, 1, 1)
SCHEMA = "source string, observed_at timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def spans(readings, ttl, now):
    """(source, status, seconds, readings) by hand."""
    out = []
    for source in {s for s, _ in readings if s}:
        times, opened, n = sorted(t for s, t in readings if s == source and t is not None), None, 0
        for i, t in enumerate(times):
            if opened is None:
                opened, n = t, 0
                out.append((source, "LIVE", t, 0))
            n += 1
            if i + 1 == len(times) or times[i + 1] - t >= ttl:
                if t + ttl <= now:
                    out.append((source, "UNAVAILABLE", t + ttl, n))
                opened = None
    return sorted(out)


def batches(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame([(s, None if t is None else at(t)) for s, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def changes(spark, base):
    got = spark.read.schema(L.TRANSITIONS).parquet(f"{base}/changes")
    return sorted((r.source, r.status, (r.at - START).total_seconds(), r.readings) for r in got.collect())


@pytest.fixture
def expected(spark):
    return spark.createDataFrame([("a", "live"), ("b", "live"), ("s", "satellite"), ("dem", "static"), ("never", "live")], "source string, kind string")


PARTS = [
    [("a", 0), ("a", 100), ("b", 5), ("s", 1), ("a", 100), ("x", None)],
    [("a", 390), ("b", 20), ("b", 395)],
    [(None, 700), (None, 700)],  # a clock: nobody reads anything, yet sources expire
    [(None, 760), ("b", 720), ("b", 715)],
    [(None, 900)], [(None, 5000)], [(None, 5000)],
]


def test_a_silent_source_expires_by_timer_and_a_restart_keeps_its_state(spark, expected):
    readings = [r for part in PARTS for r in part]
    want = spans(readings, 300, 4000)
    whole, halves = (scratch_path(spark, f"live-{k}-{uuid.uuid4().hex[:6]}") for k in "ab")
    batches(spark, whole, PARTS)
    stream = lambda folder: L.status_changes(J.file_stream(spark, folder, SCHEMA, files_per_trigger=1))
    base = L.run_feed(stream(whole), expected, "feed")
    assert changes(spark, base) == want
    assert ("b", "UNAVAILABLE", 320, 2) in want and ("a", "UNAVAILABLE", 690, 4) in want
    # Two runs over one checkpoint, the second one with the files that came later.
    batches(spark, halves, PARTS[:2])
    half = L.run_feed(stream(halves), expected, "feed")
    assert ("a", "UNAVAILABLE", 690, 4) not in changes(spark, half)
    batches(spark, halves, PARTS[2:])
    L.run_feed(stream(halves), expected, "feed", half)
    assert changes(spark, half) == want
    # The feed speaks only when it changed.
    feed = spark.read.parquet(f"{base}/feed").orderBy("batch_id").collect()
    assert all((a.missing_sources, a.live) != (b.missing_sources, b.live) for a, b in zip(feed, feed[1:]))
    assert feed[-1].missing_sources == "a,b,never" and feed[-1].live == 0 and not feed[-1].fallback_used
    assert any(f.live == 2 for f in feed)


def test_out_of_order_readings_and_the_table_form(spark):
    draw = random.Random(5)
    readings = [(draw.choice("abc"), t + draw.randint(0, 3)) for t in range(0, 4000, 7) if t % 1300 < 500 or draw.random() < 0.02]
    parts = [readings[k : k + 90] for k in range(0, len(readings), 90)]
    for part in parts:
        draw.shuffle(part)
    parts += [[(None, 9000)], [(None, 9000)]]
    folder = scratch_path(spark, "live-c")
    batches(spark, folder, parts)
    got = J.append_and_read(L.status_changes(J.file_stream(spark, folder, SCHEMA, files_per_trigger=1), 60, "15 seconds"), "changes")
    table = spark.createDataFrame([(s, at(t)) for s, t in readings], SCHEMA)
    clock = spark.createDataFrame([(at(8985),)], "at timestamp")
    key = lambda df: sorted((r.source, r.status, r.at, r.last_seen, r.readings) for r in df.collect())
    assert key(got) == key(L.status_changes_of(table, clock, 60)) and len(key(got)) > 20
    assert [(s, x, (t - START).total_seconds(), n) for s, x, t, _, n in key(got)] == spans(readings, 60, 8985)


def test_a_busy_second_is_one_row(spark):
    rows = spark.range(10_000).select(F.lit("a").alias("source"), F.timestamp_micros(F.col("id") * 100).alias("observed_at")).coalesce(1)
    got = L.condensed(rows).collect()
    assert len(got) == 1 and got[0].n == 10_000 and got[0].last_us - got[0].first_us == 999_900


def test_a_busy_second_is_one_row_over_small_batches(spark):
    """A row a batch came out."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "500")
    try:
        rows = spark.range(10_000).select(F.lit("a").alias("source"), F.timestamp_micros(F.col("id") * 400).alias("observed_at")).coalesce(1)
        got = sorted((r.first_us, r.last_us, r.n) for r in L.condensed(rows).collect())
    finally:
        spark.conf.set(key, before)
    assert got == [(k * 1_000_000, k * 1_000_000 + 999_600, 2500) for k in range(4)]


def test_seconds_that_wait_are_packed():
    """A reading a second for four days waits in a few megabytes, and comes out the same."""
    import tracemalloc

    import numpy as np

    n = 4 * 86_400
    start = np.arange(n, dtype=np.int64) * 1_000_000
    parts = [np.column_stack([start[k::3], start[k::3] + 5, np.ones(len(start[k::3]), np.int64)]) for k in range(3)]
    tracemalloc.start()
    rows = L.Liveness._by_second(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == n and (np.diff(rows[:, 1]) > 0).all() and rows[:, 2].sum() == n
    assert peak < 150 * n
