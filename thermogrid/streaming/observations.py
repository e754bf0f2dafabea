"""Observation records: parsing, daily rollup, live periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from thermogrid.functions import wind_kmh

TTL_SECONDS = 300

_WEATHER = (
    "main struct<temp: double, feels_like: double, humidity: double, pressure: double>, wind struct<speed: double, deg: double>, "
    "clouds struct<all: double>, rain map<string, double>, snow map<string, double>, visibility double, dt bigint, sys struct<sunrise: bigint, sunset: bigint>"
)
_AIR = "list array<struct<dt: bigint, main: struct<aqi: int>, components: map<string, double>>>"


def parse_observations(raw: DataFrame, payload: str = "props", schema: str = "k bigint") -> DataFrame:
    """(source, observed_at, value, fields..., complete): the payload as typed fields and whether it is usable."""
    doc = F.from_json(payload, schema)
    parsed = raw.withColumn("_doc", doc)
    fields = [f.split()[0] for f in schema.split(", ")]
    complete = F.col("observed_at").isNotNull() & F.col("value").isNotNull()
    for f in fields:
        complete = complete & F.col("_doc")[f].isNotNull()
    return parsed.select(*[c for c in raw.columns if c != payload], F.col("_doc.*"), complete.alias("complete"))


def parse_weather(raw: DataFrame, payload: str) -> DataFrame:
    """Current-weather payloads to typed rows; rows without temperature or time are unusable and dropped.

    Absent rain or snow means none fell.
    """
    w = F.from_json(payload, _WEATHER)
    rows = raw.select(*[c for c in raw.columns if c != payload], w.alias("w")).where("w.main.temp is not null and w.dt is not null")
    return rows.select(
        *[c for c in raw.columns if c != payload], F.timestamp_seconds("w.dt").alias("observed_at"), F.col("w.main.temp").alias("temperature"),
        F.col("w.main.humidity").alias("humidity"), F.col("w.main.pressure").alias("pressure"), F.col("w.wind.speed").alias("wind_speed"),
        wind_kmh("w.wind.speed").alias("wind_speed_kmh"), F.col("w.clouds.all").alias("cloud_cover"),
        F.coalesce(F.col("w.rain")["1h"], F.lit(0.0)).alias("rain_mm"), F.coalesce(F.col("w.snow")["1h"], F.lit(0.0)).alias("snow_mm"),
        ((F.col("w.dt") >= F.col("w.sys.sunrise")) & (F.col("w.dt") < F.col("w.sys.sunset"))).alias("is_day"),
    )


def parse_air_quality(raw: DataFrame, payload: str, components: Sequence[str] = ("pm2_5", "pm10", "no2", "so2", "co", "o3")) -> DataFrame:
    """Air-quality payloads, one row per reading."""
    keep = [c for c in raw.columns if c != payload]
    items = raw.select(*keep, F.explode(F.from_json(payload, _AIR)["list"]).alias("r"))
    return items.select(*keep, F.timestamp_seconds("r.dt").alias("observed_at"), F.col("r.main.aqi").alias("aqi"), *[F.col("r.components")[c].alias(c) for c in components])


def daily_rollup(observations: DataFrame, station: str, parameter: str, late: str | None) -> DataFrame:
    """Mean and count per station, parameter and day.

    On a stream, `late` is how long a day stays open after newer readings have come; None keeps every day open, so no reading
    is left out and the state holds one row per station, parameter and day. A stream that closes days should keep what
    comes later beside it (readings_before).
    """
    day = F.window("observed_at", "1 day")
    rows = observations.withWatermark("observed_at", late) if observations.isStreaming and late else observations
    agg = rows.groupBy(day, station, parameter).agg(F.avg("value").alias("mean_value"), F.count("value").alias("n"))
    return agg.select(F.to_date("window.start").alias("date"), station, parameter, "mean_value", "n")


def readings_before(observations: DataFrame, closed_until) -> DataFrame:
    """Readings of days that a rollup has closed already, for a table of their own."""
    return observations.where(F.col("observed_at") < F.lit(closed_until))


def live_periods(observations: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str | None = None) -> DataFrame:
    """Spans in which a source never went silent for the time-to-live; a span's end is when its reading expires.

    A stream needs `late`: a span is given out once readings that much newer have come, and readings later than that are not in it.
    """
    if observations.isStreaming:
        if late is None:
            raise ValueError("a stream needs to know how late readings may come")
        rows = observations.withWatermark("observed_at", late).withColumns({"first": F.col("observed_at"), "last": F.col("observed_at"), "_n": F.lit(1)})
        gap = F.lit(f"{ttl_seconds} seconds")
    else:
        # A busy source is first reduced to one row per minute, so its readings never meet in one task.
        minute = F.date_trunc("minute", "observed_at")
        rows = observations.groupBy("source", minute.alias("_m")).agg(
            F.min("observed_at").alias("first"), F.max("observed_at").alias("last"), F.count(F.lit(1)).alias("_n"))
        seconds = (F.unix_micros("last") - F.unix_micros("first") + F.lit(ttl_seconds * 1_000_000)) / F.lit(1e6)
        gap = F.make_interval(secs=seconds.cast("decimal(18,6)"))
    spans = rows.groupBy("source", F.session_window("observed_at" if observations.isStreaming else "first", gap)).agg(
        F.sum("_n").alias("readings"), F.max("last").alias("last_seen"))
    return spans.select("source", F.col("session_window.start").alias("live_from"), "last_seen", F.col("session_window.end").alias("expires_at"), "readings")
