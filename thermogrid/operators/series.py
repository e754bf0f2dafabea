"""Daily series: rolling means, gaps, climatology, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from thermogrid.functions import meteo_season
from thermogrid.operators.keyed import keep_first

__all__ = [
    "drop_repeated_dates", "rolling_means", "missing_days", "monthly_means", "monthly_climatology",
    "seasonal_climatology", "nearest_date_join", "month_lookup_join", "split_by_date", "date_folds", "expanding_folds",
]


def drop_repeated_dates(df: DataFrame, by: Sequence[str], date: str, order: Sequence[str]) -> DataFrame:
    return keep_first(df, [*by, date], order)


def rolling_means(df: DataFrame, by: Sequence[str], date: str, columns: Sequence[str], rows: int, suffix: str) -> DataFrame:
    """Trailing mean over a number of rows (not days), fewer at the start. One row per key and day goes in."""
    w = W.partitionBy(*by).orderBy(date).rowsBetween(-(rows - 1), 0)
    return df.withColumns({f"{c}{suffix}": F.avg(c).over(w) for c in columns})


def missing_days(df: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """Days absent between the first and last of each series, spread out from the gap that holds them."""
    days = df.select(*by, date).distinct()
    following = F.lead(date).over(W.partitionBy(*by).orderBy(date))
    gaps = days.withColumn("_next", following).where(F.datediff("_next", date) > 1)
    return gaps.select(*by, F.explode(F.sequence(F.date_add(date, 1), F.date_sub("_next", 1))).alias("missing"))


def monthly_means(df: DataFrame, by: Sequence[str], date: str, columns: Sequence[str]) -> DataFrame:
    """Calendar-month means on a gapless month spine."""
    month = F.trunc(date, "MM")
    means = df.groupBy(*by, month.alias("month")).agg(*[F.avg(c).alias(c) for c in columns])
    ends = means.groupBy(*by).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(means, [*by, "month"], "left")


def monthly_climatology(df: DataFrame, date: str, columns: Sequence[str]) -> DataFrame:
    """Twelve rows over all years; months without data are null."""
    means = df.groupBy(F.month(date).alias("month")).agg(*[F.avg(c).alias(c) for c in columns])
    spine = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return spine.join(F.broadcast(means), "month", "left")


def seasonal_climatology(df: DataFrame, date: str, columns: Sequence[str]) -> DataFrame:
    means = df.groupBy(meteo_season(date).alias("season")).agg(*[F.avg(c).alias(c) for c in columns])
    spine = df.sparkSession.createDataFrame([(s,) for s in ("DJF", "MAM", "JJA", "SON")], "season string")
    return spine.join(F.broadcast(means), "season", "left")


def nearest_date_join(
    events: DataFrame, series: DataFrame, date: str, series_date: str, tie: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Each event date takes the nearest series row on either side, within its `by` group; the earlier date wins a tie.

    The two date lists are merged once: last known row before and next row after, both by running aggregates
    over distinct dates only. The result goes back to the events by an equi-join on the date, so no event is
    ever paired with the whole series.
    """
    payload = [c for c in series.columns if c not in by]
    rows = keep_first(series, [*by, series_date], tie) if tie else series
    day_list = events.select(*by, F.col(date).alias("_d")).distinct()
    known = rows.select(*by, F.col(series_date).alias("_d"), F.struct(*payload).alias("_row"))
    merged = day_list.withColumn("_row", F.lit(None).cast(known.schema["_row"].dataType)).unionByName(known)
    by_day = merged.groupBy(*by, "_d").agg(F.max("_row").alias("_row"))
    # Years cut the day axis into bounded pieces; each piece learns its neighbours from the year summary.
    yearly = by_day.where("_row is not null").groupBy(*by, F.year("_d").alias("_y")).agg(
        F.max_by("_row", "_d").alias("last"), F.min_by("_row", "_d").alias("first"))
    order = W.partitionBy(*by).orderBy("_y")
    edges = yearly.select(*by, "_y", F.lit(True).alias("real"), "last", "first")
    span = by_day.select(*by, F.year("_d").alias("_y")).distinct().join(edges, [*by, "_y"], "left")
    carried = span.select(
        *by, "_y",
        F.last("last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before_year"),
        F.first("first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after_year"),
    )
    w = W.partitionBy(*by, "_y").orderBy("_d")
    around = (
        by_day.withColumn("_y", F.year("_d"))
        .join(carried, [*by, "_y"])
        .withColumns({
            "_before": F.coalesce(F.last("_row", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("_before_year")),
            "_after": F.coalesce(F.first("_row", True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("_after_year")),
        })
    )
    before = F.abs(F.datediff("_d", F.col("_before")[series_date]))
    after = F.abs(F.datediff("_d", F.col("_after")[series_date]))
    choice = F.when(F.col("_after").isNull() | (before <= after), F.col("_before")).otherwise(F.col("_after"))
    nearest = around.select(*by, F.col("_d").alias(date), choice.alias("_row")).where(F.col("_row").isNotNull())
    return events.join(nearest, [*by, date]).select(*events.columns, *[F.col("_row")[c].alias(f"nearest_{c}") for c in payload])


def month_lookup_join(events: DataFrame, monthly: DataFrame, date: str, columns: Sequence[str]) -> DataFrame:
    renamed = monthly.select(F.col("month").alias("_m"), *[F.col(c).alias(f"{c}_monthly_mean") for c in columns])
    return events.withColumn("_m", F.trunc(date, "MM")).join(renamed, "_m", "left").drop("_m")


def _date_ranks(df: DataFrame, date: str) -> DataFrame:
    """Distinct dates with their 0-based rank and number: a calendar, bounded by the days covered."""
    days = df.select(date).distinct()
    n = days.agg(F.count(F.lit(1)).alias("n")).scalar()
    w = W.orderBy(date)
    return days.select(date, (F.row_number().over(w) - 1).alias("_rank"), n.alias("_n"))


def split_by_date(df: DataFrame, date: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Earliest dates train, middle dates validate, latest dates test."""
    ranks = _date_ranks(df, date)
    n_train = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(train)).cast("int"))
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(validation)).cast("int"))
    n_val = F.when(n_train + n_val >= F.col("_n"), F.col("_n") - n_train - 1).otherwise(n_val)
    part = (
        F.when(F.col("_rank") < n_train, F.lit("train"))
        .when(F.col("_rank") < n_train + n_val, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return df.join(ranks.select(date, part.alias("split")), date)


def date_folds(df: DataFrame, date: str, folds: int) -> DataFrame:
    """Contiguous folds of dates; the first folds take one more date when the division leaves a rest."""
    ranks = _date_ranks(df, date)
    k = F.least(F.lit(folds), F.greatest(F.lit(2), F.col("_n").cast("int")))
    size, rest = F.floor(F.col("_n") / k), F.col("_n") % k
    wide = rest * (size + 1)
    fold = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (size + 1))).otherwise(
        rest + F.floor((F.col("_rank") - wide) / size)
    )
    return df.join(ranks.select(date, fold.cast("int").alias("fold")), date)


def expanding_folds(df: DataFrame, date: str, folds: int) -> DataFrame:
    """(fold, role) pairs per row for the mode that trains on earlier dates only."""
    folded = date_folds(df, date, folds)
    uses = F.transform(
        F.sequence(F.greatest(F.col("fold"), F.lit(1)), F.lit(folds - 1)),
        lambda f: F.struct(f.alias("test_fold"), F.when(f == F.col("fold"), F.lit("test")).otherwise(F.lit("train")).alias("role")),
    )
    return folded.where(F.col("fold") < folds).select("*", F.inline(uses))
