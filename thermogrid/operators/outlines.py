"""Points inside outlines, by a cover of cells: only points in cells that an outline runs through look at edges, and only at that cell's.

A cover is a table of cells: inner ones, and border ones with the pieces of outline in them. It says for every point exactly what casting a
ray over all edges says, to the last bit, since the pieces in a cell are tested with the same formula and the edges elsewhere count as
one number per cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from thermogrid.functions import RING_TYPE, segment_distance
from thermogrid.session import scratch_path

__all__ = ["ring_rows", "cell_side", "outline_cover", "margin_cover", "where_inside", "mark_inside", "where_near"]

_SLACK = 1e-6  # of a cell: far above rounding as long as coordinates stay below some 1e8 cells


def ring_rows(spark: SparkSession, *rings: Sequence[Sequence[float]]) -> DataFrame:
    """Outlines given as positions, one row a ring; repeating the first position at the end is optional."""
    return spark.createDataFrame([([(float(x), float(y)) for x, y in ring],) for ring in rings], f"ring {RING_TYPE}")


def cell_side(ring: Sequence[Sequence[float]]) -> float:
    """Side of a cover's cells for one outline: its box is cut into 16 to 512 columns or rows, more for longer outlines."""
    extent = max(max(p[k] for p in ring) - min(p[k] for p in ring) for k in (0, 1))
    return extent / min(512, max(16, 4 * math.isqrt(len(ring)))) if extent > 0 else 1.0


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written once, so that the size of the cover is known when Spark decides whether to broadcast it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _edges(ring: str) -> Column:
    closed = F.concat(ring, F.slice(ring, 1, 1))
    count = F.greatest(F.size(closed) - 1, F.lit(0))
    return F.arrays_zip(F.slice(closed, F.lit(1), count).alias("a"), F.slice(closed, F.lit(2), count).alias("b"))


def _strips(edge: Column, size: float, slack: float) -> Column:
    """Rows of cells that an edge comes within `slack` of."""
    s, (low, high) = F.lit(size), (fn(edge["a"]["y"], edge["b"]["y"]) for fn in (F.least, F.greatest))
    return F.sequence(F.floor((low - slack) / s), F.floor((high + slack) / s))


def _columns(edge: Column, size: float, slack: float) -> tuple[Column, Column]:
    """First and last column of cells that an edge comes within `slack` of, inside the row `iy`."""
    a, b, s = edge["a"], edge["b"], F.lit(size)
    left, right = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])

    def x_at(y: Column) -> Column:
        y = F.greatest(F.least(a["y"], b["y"]), F.least(F.greatest(a["y"], b["y"]), y))
        return F.greatest(left, F.least(right, (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))

    ends = x_at(F.col("iy") * s - slack), x_at((F.col("iy") + 1) * s + slack)
    level = a["y"] == b["y"]
    low, high = F.when(level, left).otherwise(F.least(*ends)), F.when(level, right).otherwise(F.greatest(*ends))
    return F.floor((low - slack) / s), F.floor((high + slack) / s)


def outline_cover(rings: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Cells of the insides of outlines (column `ring`; the rings of one key `by` count together, so holes need no flag).

    Returns (by..., ix, iy, base, pieces): how many edges a ray from the cell's lower side meets outside the cell, and the edges in the
    cell. `from_a`, `from_b` say that the outline goes on to the right, outside the cell, at that end of the edge: above that
    height the ray meets one edge more or less. No ray meets a level edge, but its ends count too. A ring without area covers nothing.
    Rows grow with the outline's pieces per cell and the inner cells; a window holds one row of cells.
    """
    slack = size * _SLACK
    chain = rings.select(*by, _edges("ring").alias("e")).where(F.size("e") > 0)
    n = F.size("e")
    before = F.concat(F.slice("e", n, F.lit(1)), F.slice("e", F.lit(1), n - 1))
    after = F.concat(F.slice("e", F.lit(2), n - 1), F.slice("e", F.lit(1), F.lit(1)))
    edges = chain.select(*by, F.inline(F.arrays_zip(before.alias("before"), F.col("e").alias("edge"), after.alias("after"))))
    strips = edges.withColumn("iy", F.explode(_strips(F.col("edge"), size, slack)))
    first, last = _columns(F.col("edge"), size, slack)
    strips = strips.withColumns({
        "first": first, "last": last, "before": _columns(F.col("before"), size, slack)[0], "after": _columns(F.col("after"), size, slack)[0],
    })
    cells = strips.withColumn("ix", F.explode(F.sequence("first", "last")))
    a, b, bottom = F.col("edge.a"), F.col("edge.b"), F.col("iy") * F.lit(size) - slack
    spans = (a["y"] > bottom) != (b["y"] > bottom)
    piece = F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"),
        ((a["y"] > bottom) & (F.col("before") > F.col("ix"))).alias("from_a"), ((b["y"] > bottom) & (F.col("after") > F.col("ix"))).alias("from_b"),
    )
    starts = F.when(spans & (F.col("ix") == F.col("first")), 1).otherwise(0)
    border = cells.groupBy(*by, "iy", "ix").agg(F.collect_list(piece).alias("pieces"), F.sum(starts).alias("starts"))
    row = W.partitionBy(*by, "iy").orderBy(F.desc("ix"))
    right = F.coalesce(F.sum("starts").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = border.select(*by, "iy", "ix", "pieces", right.alias("base"), F.lag("ix").over(row).alias("next"))
    inner = F.when((F.col("base") % 2 == 1) & (F.col("next") > F.col("ix") + 1), F.sequence(F.col("ix") + 1, F.col("next") - 1)).otherwise(F.array().cast("array<bigint>"))
    entry = lambda x, pieces: F.struct(x.alias("ix"), pieces.alias("pieces"))
    none = F.slice("pieces", 1, 0)
    return known.select(*by, "iy", "base", F.inline(F.concat(F.array(entry(F.col("ix"), F.col("pieces"))), F.transform(inner, lambda x: entry(x, none))))).select(*by, "ix", "iy", "base", "pieces")


def margin_cover(rings: DataFrame, size: float, margin: float) -> DataFrame:
    """(ix, iy, pieces): cells within `margin` of outlines, with the edges that near."""
    slack = margin + size * _SLACK
    edges = rings.select(F.explode(_edges("ring")).alias("edge"))
    strips = edges.withColumn("iy", F.explode(_strips(F.col("edge"), size, slack)))
    cells = strips.withColumn("ix", F.explode(F.sequence(*_columns(F.col("edge"), size, slack))))
    return cells.groupBy("ix", "iy").agg(F.collect_list("edge").alias("pieces"))


def _odd(px: Column, py: Column) -> Column:
    """Whether a ray to the right meets an odd number of edges."""

    def met(n: Column, e: Column) -> Column:
        crosses = (e["y1"] > py) != (e["y2"] > py)
        at = (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        own = F.when(crosses & (px < at), 1).otherwise(0)
        beyond = [F.when(e[flag] & (e[y] <= py), 1).otherwise(0) for flag, y in (("from_a", "y1"), ("from_b", "y2"))]
        return n + own + beyond[0] + beyond[1]

    return F.aggregate("_pieces", F.col("_base"), met) % 2 == 1


def _met(cover: DataFrame, x: str, y: str, size: float, test) -> tuple[DataFrame, list[Column]]:
    renamed = _stored(cover, "cover").select(*[F.col(c).alias(f"_{c}") for c in cover.columns])
    key = lambda v: F.floor(F.when(~F.isnan(F.col(v).cast("double")), F.col(v)) / F.lit(size))
    return renamed, [key(x) == F.col("_ix"), key(y) == F.col("_iy"), test(F.col(x), F.col(y))]


def where_inside(points: DataFrame, rings: DataFrame, x: str, y: str, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Points inside at least one of the outlines, each once. Points without a position are inside nothing."""
    cover, on = _met(outline_cover(rings, size, by), x, y, size, _odd)
    return points.join(cover, on, "left_semi")


def mark_inside(points: DataFrame, rings: DataFrame, x: str, y: str, size: float, name: str = "inside") -> DataFrame:
    """All points with a flag: inside the outlines, taken together."""
    cover, on = _met(outline_cover(rings, size), x, y, size, _odd)
    return points.join(cover, on, "left").withColumn(name, F.col("_ix").isNotNull()).select(*points.columns, name)


def where_near(points: DataFrame, rings: DataFrame, x: str, y: str, size: float, margin: float) -> DataFrame:
    """Points within `margin` of an outline."""

    def close(px: Column, py: Column) -> Column:
        return F.exists("_pieces", lambda e: segment_distance(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]) <= F.lit(margin))

    cover, on = _met(margin_cover(rings, size, margin), x, y, size, close)
    return points.join(cover, on, "left_semi")
