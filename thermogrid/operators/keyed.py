"""Keep-first, latest, top-n and set operators that combine before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

__all__ = [
    "keep_first", "latest_per_key", "top_n", "union_all", "first_by_priority", "insert_ignore",
    "not_yet_stored", "global_row", "attach_row", "drop_duplicate_rows",
]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in `order`. An aggregate, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_kept"))
    return kept.select(*keys, *[F.col("_kept")[c].alias(c) for c in rest]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, tie: Sequence[str] = ()) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *tie)).alias("_kept"))
    return kept.select(*keys, *[F.col("_kept")[c].alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The n first rows per key. Spark limits each task to n rows per key before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_by_priority(frames: Sequence[DataFrame], keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Union of providers; for each key the earliest provider in the list wins."""
    tagged = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    return keep_first(union_all(tagged), keys, ["_priority", *tie]).drop("_priority")


def drop_duplicate_rows(df: DataFrame, id_column: str, compare: Sequence[str] | None = None) -> DataFrame:
    """Drop rows equal on all compared columns (nulls are equal), keep the lowest id."""
    compare = list(compare) if compare else [c for c in df.columns if c != id_column]
    return keep_first(df, compare, [id_column])


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of `incoming` whose key is new; repeated keys inside `incoming` keep one row."""
    rest = [c for c in incoming.columns if c != key]
    once = keep_first(incoming, [key], rest) if rest else incoming.distinct()
    return once.join(existing.select(key), key, "left_anti")


def not_yet_stored(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return wanted.join(stored.select(key), key, "left_anti")


def global_row(stats: DataFrame) -> Column:
    """A one-row table as a struct column: a scalar subquery, computed once, no join."""
    return stats.select(F.struct(*stats.columns)).scalar()


def attach_row(df: DataFrame, name: str, stats: DataFrame) -> DataFrame:
    """Put a one-row table on every row as the struct column `name`.

    Expressions that need a figure many times should read it from here: the subquery then stands in the plan once.
    """
    return df.withColumn(name, global_row(stats))
