"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from thermogrid import constants as K
from thermogrid.functions.numeric import _c, round_even

__all__ = ["meteo_season", "local_season", "compact_date", "iso_timestamp", "month_start", "span_years", "unix_to_timestamp"]


def _season(month: Column, table: dict[str, list[int]]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, months in table.items():
        out = out.when(month.isin(months), F.lit(name))
    return out


def meteo_season(date) -> Column:
    return _season(F.month(_c(date)), K.METEO_SEASONS)


def local_season(date_text) -> Column:
    """Season of a yyyy-MM-dd text; anything unreadable is 'unknown'."""
    month = F.get(F.split(_c(date_text), "-"), F.lit(1))
    return F.coalesce(_season(month.try_cast("int"), K.LOCAL_SEASONS), F.lit("unknown"))


def compact_date(text) -> Column:
    return F.to_date(_c(text), "yyyyMMdd")


def iso_timestamp(text) -> Column:
    return F.to_timestamp(_c(text))


def month_start(date) -> Column:
    return F.trunc(_c(date), "MM")


def span_years(first, last) -> Column:
    return round_even(F.datediff(_c(last), _c(first)) / F.lit(365.25), 1)


def unix_to_timestamp(seconds) -> Column:
    return F.timestamp_seconds(_c(seconds))
