"""How a query is registered: a key ending in its inventory id, a Spark function, an optional SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from thermogrid.catalog.views import Data, VIEWS, view_sql


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Data], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Data(spark, folder))


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register a query. The SQL names views directly; the views it needs are found by their names."""

    def register(build: Callable[[Data], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query(key, build, _complete(sql) if sql else None)
        return build

    return register


def _expand_rounding(sql: str) -> str:
    """R2(x), R4(x), R6(x)...: round half to even at that many digits, as functions.round_even does."""
    while (m := re.search(r"\bR(\d)\(", sql)) is not None:
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        scale = f"1{'0' * int(m.group(1))}.0e0"
        sql = f"{sql[: m.start()]}(round_even(({sql[m.end() : i - 1]}) * {scale}, 0) / {scale}){sql[i:]}"
    return sql


def _complete(sql: str) -> str:
    sql = _expand_rounding(sql)
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    clause = view_sql(used)
    body = sql.strip()
    if clause and body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE" + clause.rstrip()[4:] + ",\n" + body[15:]
    if clause and body.upper().startswith("WITH "):
        return clause.rstrip() + ",\n" + body[5:]
    return clause + body


def all_queries() -> dict[str, Query]:
    import thermogrid.catalog.sources_queries  # noqa: F401
    import thermogrid.catalog.scalar_queries  # noqa: F401
    import thermogrid.catalog.function_queries  # noqa: F401
    import thermogrid.catalog.join_queries  # noqa: F401
    import thermogrid.catalog.aggregate_queries  # noqa: F401
    import thermogrid.catalog.window_queries  # noqa: F401
    import thermogrid.catalog.city_queries  # noqa: F401
    import thermogrid.catalog.stream_queries  # noqa: F401
    import thermogrid.catalog.model_queries  # noqa: F401

    return QUERIES
