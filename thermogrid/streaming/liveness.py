"""Timed expiry of live readings: keyed state and event-time timers on a stream, and the statuses that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from thermogrid.operators.keyed import latest_per_key
from thermogrid.session import scratch_path
from thermogrid.streaming.observations import TTL_SECONDS

#: One row a change: the reading that opened the span, or the moment its last reading expired.
TRANSITIONS = "source string, status string, at timestamp, last_seen timestamp, readings long"
_SPAN = "first bigint, last bigint, n bigint"
_SECOND = 1_000_000
_HELD = 1 << 16  # seconds that a task puts together, and that stand in one value of the state


def with_state_store(spark) -> None:
    """Timers need a state store with column families; a setting that names another provider is replaced."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def condensed(readings: DataFrame) -> DataFrame:
    """One row per source, second and stretch of a task's input (source, last, first_us, last_us, n), so that a busy source's readings shrink before they meet.

    Readings of one second never lie a time-to-live apart, so nothing is lost. Rows without a source are ticks of a clock:
    they move the stream's time on and count as nobody's reading. Rows without a time are left out.
    """

    def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        by = rows.groupby([rows.source, rows.last_us // _SECOND], dropna=False, sort=False)
        out = by.agg(first_us=("first_us", "min"), last_us=("last_us", "max"), n=("n", "sum")).reset_index(level=0)
        return out.assign(source=out.source.astype(object).where(out.source.notna(), None)).reset_index(drop=True)

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in frames:
            held.append(merged([pd.DataFrame({"source": frame.source, "first_us": frame.us, "last_us": frame.us, "n": 1})]))
            rows += len(held[-1])
            if rows > _HELD:
                held = [merged(held)]
                rows = len(held[0])
            if rows > _HELD // 2 and len(held) == 1:
                yield held.pop()
                rows = 0
        if held:
            yield merged(held)

    times = readings.select("source", F.unix_micros("observed_at").alias("us")).where("us IS NOT NULL")
    small = times.mapInPandas(shrink, "source string, first_us long, last_us long, n long")
    return small.withColumn("last", F.timestamp_micros("last_us"))


class Liveness(StatefulProcessor):
    """Spans of one source. Readings wait until the stream's time has passed them, and are then taken in order of time.

    What waits are three numbers a second (first, last, n), held as packed arrays.
    """

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.span = handle.getValueState("span", _SPAN)

    def _held(self) -> list[np.ndarray]:
        return [np.frombuffer(bytes(x[0]), np.int64).reshape(-1, 3) for x in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # a tick has moved the time on already
            for _ in rows:
                pass
            return
        held = self._held()
        held += [np.ascontiguousarray(frame[["first_us", "last_us", "n"]].to_numpy(np.int64)) for frame in rows]
        yield from self._advance(key, timerValues, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues, self._held())

    @staticmethod
    def _by_second(held: list[np.ndarray]) -> np.ndarray:
        """One row a second, in order."""
        rows = np.concatenate([np.empty((0, 3), np.int64), *held])
        rows = rows[np.argsort(rows[:, 1], kind="stable")]
        if not len(rows):
            return rows
        starts = np.flatnonzero(np.diff(rows[:, 1] // _SECOND, prepend=rows[0, 1] // _SECOND - 1))
        return np.column_stack([np.minimum.reduceat(rows[:, 0], starts), np.maximum.reduceat(rows[:, 1], starts), np.add.reduceat(rows[:, 2], starts)])

    def _advance(self, key, timer_values, held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        rows = self._by_second(held)
        ready = int(np.searchsorted(rows[:, 1], passed, "right"))
        waiting, taken = rows[ready:], rows[:ready]
        span = tuple(self.span.get()) if self.span.exists() else None
        known = span is not None  # its LIVE has gone out
        if known:
            taken = np.concatenate([np.array([span], np.int64), taken])
        out = pd.DataFrame()
        if len(taken):
            last = np.maximum.accumulate(taken[:, 1])
            starts = np.flatnonzero(np.append(True, taken[1:, 0] - last[:-1] >= self.ttl))
            first, n = taken[starts, 0], np.add.reduceat(taken[:, 2], starts)
            last = last[np.append(starts[1:], len(taken)) - 1]
            over = last + self.ttl <= passed
            over[:-1] = True
            span = None if over[-1] else (int(first[-1]), int(last[-1]), int(n[-1]))
            opened = np.arange(len(first)) >= known
            parts = [(2 * np.flatnonzero(opened), "LIVE", first[opened], first[opened], np.zeros(opened.sum(), np.int64))]
            parts += [(2 * np.flatnonzero(over) + 1, "UNAVAILABLE", last[over] + self.ttl, last[over], n[over])]
            out = pd.concat([pd.DataFrame({"order": o, "status": s, "at": a, "last_seen": b, "readings": c}) for o, s, a, b, c in parts]).sort_values("order")
        if span is None:
            self.span.clear()
        else:
            self.span.update(tuple(int(x) for x in span))
        if len(waiting):
            self.waiting.put([(waiting[i : i + _HELD].tobytes(),) for i in range(0, len(waiting), _HELD)])
        else:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [int(waiting[0, 1])] if len(waiting) else []
        due += [span[1] + self.ttl] if span is not None else []
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        for i in range(0, len(out), 10_000):
            part = out.iloc[i : i + 10_000]
            at, seen = (pd.to_datetime(part[c].to_numpy(), unit="us") for c in ("at", "last_seen"))
            yield pd.DataFrame({"source": key[0], "status": part.status.to_numpy(), "at": at, "last_seen": seen, "readings": part.readings.to_numpy()})

    def close(self) -> None:
        pass


def status_changes(readings: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "10 seconds") -> DataFrame:
    """A stream of LIVE and UNAVAILABLE changes per source, from a stream of (source, observed_at).

    A source turns LIVE with a reading, and UNAVAILABLE by a timer, without a new reading, once the stream's time has passed its
    last one by the time-to-live; `readings` then tells how many the span had. The stream's time is the newest reading of any
    source, or tick of a clock (a row without a source), less `late`; readings may come out of order within `late`, older
    ones are dropped by the engine (readings_before keeps them apart). State is one span a source and the readings that the
    time has not passed yet, a row a second.
    """
    with_state_store(readings.sparkSession)
    # Ticks stay in: a filter on the source would be pushed below the watermark, and time would stand still.
    rows = condensed(readings).withWatermark("last", late)
    return rows.groupBy("source").transformWithStateInPandas(
        statefulProcessor=Liveness(ttl_seconds * _SECOND), outputStructType=TRANSITIONS, outputMode="append", timeMode="EventTime"
    )


def status_changes_of(readings: DataFrame, clock: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The same rows from a table of readings and a one-row table `clock` (at): what a stream has given out once its time is `at`."""
    from thermogrid.streaming.observations import live_periods

    spans = live_periods(readings.where("source IS NOT NULL"), ttl_seconds).crossJoin(F.broadcast(clock.select(F.col("at").alias("now"))))
    opened = spans.where("live_from <= now").select("source", F.lit("LIVE").alias("status"), F.col("live_from").alias("at"), F.col("live_from").alias("last_seen"), F.lit(0).cast("long").alias("readings"))
    closed = spans.where("expires_at <= now").select("source", F.lit("UNAVAILABLE").alias("status"), F.col("expires_at").alias("at"), "last_seen", "readings")
    return opened.unionByName(closed)


def current_status(changes: DataFrame, expected: DataFrame) -> DataFrame:
    """(source, kind, status) of every expected source from the changes so far.

    A static source is STATIC; a satellite source keeps its LATEST_OBSERVATION once seen; any other is what its last change says,
    and UNAVAILABLE if it has none.
    """
    last = latest_per_key(changes.select("source", "status", "at"), ["source"], "at", ["status"])
    joined = expected.join(last.withColumnRenamed("status", "last"), "source", "left")
    status = (
        F.when(F.col("kind") == "static", F.lit("STATIC"))
        .when(F.col("last").isNull(), F.lit("UNAVAILABLE"))
        .when(F.col("kind") == "satellite", F.lit("LATEST_OBSERVATION"))
        .otherwise(F.col("last"))
    )
    return joined.select("source", "kind", status.alias("status"))


def run_feed(changes: DataFrame, expected: DataFrame, label: str, base: str | None = None) -> str:
    """Runs a status stream over all that is there, and keeps three tables below the folder it returns.

    `changes/batch=n` holds each micro-batch's changes, `state/batch=n` the last change of every source after it, and
    `feed/batch=n` one row (batch, missing_sources, live, fallback_used) only where that differs from the batch before: an
    unchanged feed stays silent. A batch that is tried again writes the same folders again, so a restart from the checkpoint
    neither loses nor doubles anything.
    """
    spark = changes.sparkSession
    base = base or scratch_path(spark, label)

    def summary(state: DataFrame) -> tuple:
        s = current_status(state, expected)
        lacking = F.array_sort(F.collect_list(F.when(F.col("status") == "UNAVAILABLE", F.col("source"))))
        return tuple(s.agg(
            F.array_join(lacking, ",").alias("missing_sources"), F.count_if(F.col("status") == "LIVE").alias("live"),
            F.coalesce(F.bool_or((F.col("kind") == "satellite") & (F.col("status") == "UNAVAILABLE")), F.lit(False)).alias("fallback_used"),
        ).first())

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch={batch_id}")
        new = spark.read.schema(batch.schema).parquet(f"{base}/changes/batch={batch_id}")
        before = spark.createDataFrame([], batch.schema)
        if batch_id:
            before = spark.read.schema(batch.schema).parquet(f"{base}/state/batch={batch_id - 1}")
        state = latest_per_key(before.unionByName(new), ["source"], "at", ["status"])
        state.write.mode("overwrite").parquet(f"{base}/state/batch={batch_id}")
        state = spark.read.schema(batch.schema).parquet(f"{base}/state/batch={batch_id}")
        now = summary(state)
        if not batch_id or now != summary(before):
            row = spark.createDataFrame([(batch_id, *now)], "batch_id long, missing_sources string, live long, fallback_used boolean")
            row.write.mode("overwrite").parquet(f"{base}/feed/batch={batch_id}")

    run = (
        changes.writeStream.outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start()
    )
    run.awaitTermination()
    return base
