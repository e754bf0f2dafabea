"""The authoritative snapshot: latest reading per source, freshness, history, change feed, live scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from thermogrid.operators.keyed import attach_row
from thermogrid.plans.feature_table import override_columns
from thermogrid.streaming.observations import TTL_SECONDS


def latest_readings(observations: DataFrame, columns: Sequence[str], tie: str) -> DataFrame:
    """Latest reading per source; the state holds one row per source."""
    row = F.max_by(F.struct(*columns, "observed_at"), F.struct("observed_at", tie))
    return observations.groupBy("source").agg(row.alias("r")).select("source", "r.*")


def newest_reading(observations: DataFrame, columns: Sequence[str], tie: str) -> DataFrame:
    """The newest reading of all: one row, the state of a stream as well."""
    return observations.groupBy().agg(F.max_by(F.struct(*columns, "observed_at"), F.struct("observed_at", tie)).alias("r")).select("r.*")


def snapshot_id(at) -> "F.Column":
    return F.concat(F.lit("snap_"), F.date_format(at, "yyyy_MM_dd_HHmmss_SSS"))


def freshness(latest: DataFrame, expected: DataFrame, as_of: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Status per expected source (source, kind): STATIC, LATEST_OBSERVATION, LIVE or UNAVAILABLE.

    `as_of` is one row (at). A live source that has been silent longer than the time-to-live is unavailable.
    """
    seen = latest.select("source", "observed_at")  # one row per source; sources can be many, so Spark chooses the join
    joined = attach_row(expected.join(seen, "source", "left"), "_now", as_of.select("at"))
    age = F.unix_micros(F.col("_now.at").cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))
    status = (
        F.when(F.col("kind") == "static", F.lit("STATIC"))
        .when(F.col("observed_at").isNull(), F.lit("UNAVAILABLE"))
        .when(F.col("kind") == "satellite", F.lit("LATEST_OBSERVATION"))
        .when(age <= ttl_seconds * 1_000_000, F.lit("LIVE"))
        .otherwise(F.lit("UNAVAILABLE"))
    )
    return joined.select("source", "kind", "observed_at", status.alias("status"))


def feed_status(statuses: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: which sources are missing, whether fallback values are in use, and the overall state.

    `predicted` is one row (prediction), null where no prediction could be made.
    """
    lacking = F.array_sort(F.collect_list(F.when(F.col("status") == "UNAVAILABLE", F.col("source"))))
    fallback = F.coalesce(F.bool_or((F.col("kind") == "satellite") & (F.col("status") == "UNAVAILABLE")), F.lit(False))
    s = attach_row(statuses.agg(lacking.alias("missing_sources"), fallback.alias("fallback_used")), "_p", predicted.select("prediction"))
    has = F.col("_p.prediction").isNotNull()
    state = F.when(has & (F.size("missing_sources") == 0), F.lit("available")).when(has, F.lit("partial")).otherwise(F.lit("model_error"))
    return s.select("missing_sources", "fallback_used", state.alias("state"))


def newest_snapshots(snapshots: DataFrame, n: int) -> DataFrame:
    """A view of the history: its n newest snapshots, by id. The history itself is kept in full."""
    return snapshots.orderBy(F.desc("snapshot_id")).limit(n)


def change_feed(snapshots: DataFrame) -> DataFrame:
    """Each snapshot id with its first and last reading.

    On a stream this is for update mode: an id comes again whenever its readings change, however late they arrive, and the
    state holds one row per id.
    """
    return snapshots.groupBy("snapshot_id").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def score_live(cells: DataFrame, live_row: DataFrame, columns: Sequence[str], scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Override the live columns on every cell, score, and summarise."""
    scored = scorer(override_columns(cells, live_row, columns))
    return scored.agg(F.count(F.lit(1)).alias("cells"), F.avg("predicted_lst").alias("mean_lst"), F.min("predicted_lst").alias("min_lst"), F.max("predicted_lst").alias("max_lst"))
