"""Spatial joins on a regular grid, nearest features, selections and the cell lattice.

A cell's rectangle follows from its indices, so most "joins" are arithmetic: a feature works out the cells it
touches, and the counts are combined per cell before they are shuffled. No cell-feature product is formed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from thermogrid import constants as K
from thermogrid.functions import clipped_length, edge_cost, haversine_m, planar_distance, segment_distance
from thermogrid.operators.blocks import cut_blocks, reach_leaf, search_block
from thermogrid.operators.keyed import attach_row, top_n, union_all
from thermogrid.operators.nodes import NODE, cell_nodes
from thermogrid.operators.outlines import cell_side, mark_inside, ring_rows, where_inside, where_near
from thermogrid.operators.tiles import neighbours
from thermogrid.session import scratch_path, spread

__all__ = [
    "touched_cells", "count_per_cell", "rect_overlap_per_cell", "line_cells", "line_length_per_cell", "crossings",
    "network_nodes", "sphere_bounds", "nearest_features", "inverse_distance", "select_in_polygon", "mark_in_polygon", "select_in_named_area", "select_in_radius",
    "select_by_ids", "lattice_edges", "cells_with_fallback",
]


def _index(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def touched_cells(df: DataFrame, xmin, ymin, xmax, ymax, size: float = K.CELL_SIZE_M) -> DataFrame:
    """One row per cell a box touches, edges included (a box on a border belongs to both sides)."""
    x0, y0, x1, y1 = (F.col(c) if isinstance(c, str) else c for c in (xmin, ymin, xmax, ymax))
    s = F.lit(float(size))
    first_x, first_y = F.ceil(x0 / s).cast("long") - 1, F.ceil(y0 / s).cast("long") - 1
    out = df.withColumn("ix", F.explode(F.sequence(first_x, _index(x1, size))))
    return out.withColumn("iy", F.explode(F.sequence(first_y, _index(y1, size))))


def count_per_cell(points: DataFrame, x: str, y: str, size: float = K.CELL_SIZE_M, name: str = "n") -> DataFrame:
    """Points intersecting each cell."""
    return touched_cells(points.select(x, y), x, y, x, y, size).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias(name))


def rect_overlap_per_cell(rects: DataFrame, size: float = K.CELL_SIZE_M, by: Sequence[str] = ()) -> DataFrame:
    """Touching count, overlap area and mean footprint per cell for boxes (x0, y0, x1, y1)."""
    s = F.lit(float(size))
    cells = touched_cells(rects.select(*by, "x0", "y0", "x1", "y1"), "x0", "y0", "x1", "y1", size)
    left, bottom = F.col("ix") * s, F.col("iy") * s
    width = F.greatest(F.lit(0.0), F.least(F.col("x1"), left + s) - F.greatest(F.col("x0"), left))
    height = F.greatest(F.lit(0.0), F.least(F.col("y1"), bottom + s) - F.greatest(F.col("y0"), bottom))
    footprint = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return cells.groupBy("ix", "iy", *by).agg(
        F.count(F.lit(1)).alias("touching"), F.sum(width * height).alias("area"), F.avg(footprint).alias("mean_footprint")
    )


def line_cells(segments: DataFrame, size: float = K.CELL_SIZE_M, halo: float = 0.0) -> DataFrame:
    """One row per cell along a segment, or within the halo of it: columns of cells first, then only the rows crossed inside each column."""
    s, more = F.lit(float(size)), F.lit(float(halo))
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    dx = F.col("x2") - F.col("x1")
    out = segments.withColumn("ix", F.explode(F.sequence(_index(lo - more, size), _index(hi + more, size))))

    def y_at(x: Column) -> Column:
        return F.col("y1") + (x - F.col("x1")) / F.when(dx != 0, dx) * (F.col("y2") - F.col("y1"))

    ya = F.coalesce(y_at(F.greatest(lo, F.col("ix") * s - more)), F.col("y1"))
    yb = F.coalesce(y_at(F.least(hi, (F.col("ix") + 1) * s + more)), F.col("y2"))
    low, high = F.least(ya, yb), F.greatest(ya, yb)
    slack = F.lit(1e-9 * size + halo)
    return out.withColumn("iy", F.explode(F.sequence(_index(low - slack, size), _index(high + slack, size))))


def line_length_per_cell(segments: DataFrame, size: float = K.CELL_SIZE_M, by: Sequence[str] = ()) -> DataFrame:
    """Length of line inside each cell. A stretch lying exactly on a cell border counts in the upper cell."""
    s = F.lit(float(size))
    cells = line_cells(segments.select(*by, "x1", "y1", "x2", "y2"), size)
    inside = clipped_length("x1", "y1", "x2", "y2", F.col("ix") * s, F.col("iy") * s, (F.col("ix") + 1) * s, (F.col("iy") + 1) * s)
    return cells.groupBy("ix", "iy", *by).agg(F.sum(inside).alias("length")).where(F.col("length") > 0)


_SPLIT = 4  # a crowded cell is cut into 4 x 4
_SPLITS = 2  # times, at most
_CROWDED = 2048  # pairs of pieces in different directions that a cell may hold uncut
_GROUP_ROWS = 1 << 14  # pieces of whole cells that are worked on together, about
_END_POINTS = ("x1", "y1", "x2", "y2")


def _ends() -> Column:
    return F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))


def _dealt_pieces(segments: DataFrame, size: float, halo: float = 0.0) -> DataFrame:
    """Distinct pieces per cell along them: (step, ix, iy, slope, x1, y1, x2, y2), `step` being the side of the cell.

    Crowds of short pieces go to cells a quarter as wide, twice at most. Long pieces are left, since every smaller cell would hold them
    again. With a halo, a cell has all pieces that come so near, and ends of pieces without a length are pieces too.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    slope = F.when(dx != 0, dy / F.when(dx != 0, dx) + F.lit(0.0)).otherwise(F.lit(float("inf")))
    pieces = segments.select(*[F.col(c).cast("double").alias(c) for c in _END_POINTS]).distinct().withColumns({"slope": slope, "length": F.hypot(dx, dy)})
    if halo:
        ends = pieces.where("coalesce(length <= 0, true)").select(F.inline(_ends()), F.lit(float("inf")).alias("slope"), F.lit(0.0).alias("length"))
        ends = ends.where("x IS NOT NULL AND y IS NOT NULL").select(*[F.col(c[0]).alias(c) for c in _END_POINTS], "slope", "length").distinct()
        pieces = pieces.where("length > 0").unionByName(ends)
    else:
        pieces = pieces.where("length > 0")
    spark = segments.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    settled, step, crowd = [], float(size), None
    for level in range(_SPLITS + 1):
        cells = line_cells(pieces, step, halo)
        if crowd is not None:
            parents = crowd.select(F.col("ix").alias("px"), F.col("iy").alias("py"))
            cells = cells.join(parents, [F.floor(F.col("ix") / _SPLIT) == F.col("px"), F.floor(F.col("iy") / _SPLIT) == F.col("py")], "left_semi")
        cells = stored(cells.select(F.lit(step).alias("step"), "ix", "iy", "slope", "length", *_END_POINTS), "pieces")
        ways = cells.groupBy("ix", "iy", "slope").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
        load = ways.groupBy("ix", "iy").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("alike"), F.sum("length").alias("length"))
        heavy = (F.col("n") * F.col("n") - F.col("alike") > 2 * _CROWDED) & (F.col("length") < F.col("n") * F.lit(step / 2))
        crowd = stored(load.where(heavy).select("ix", "iy"), "crowded") if level < _SPLITS else None
        if crowd is None or crowd.isEmpty():
            settled.append(cells)
            break
        settled.append(cells.join(crowd, ["ix", "iy"], "left_anti"))
        pieces = cells.join(crowd, ["ix", "iy"], "left_semi").select("slope", "length", *_END_POINTS).distinct()
        step /= _SPLIT
    return union_all([c.drop("length") for c in settled])


def _meeting_pairs(dealt: DataFrame) -> DataFrame:
    """Pairs of pieces in one cell that run in different directions; pieces side by side never look at each other."""
    cell = ["step", "ix", "iy"]
    ways = dealt.select(*cell, "slope").distinct()
    turn = ways.withColumnRenamed("slope", "a_slope").join(ways.withColumnRenamed("slope", "b_slope"), cell).where("a_slope < b_slope")
    side = lambda p: dealt.select(*cell, *[F.col(c).alias(f"{p}_{c}") for c in ("slope", *_END_POINTS)])
    return turn.join(side("a"), [*cell, "a_slope"]).join(side("b"), [*cell, "b_slope"])


def crossings(segments: DataFrame, size: float = K.CELL_SIZE_M) -> DataFrame:
    """x, y: where two different pieces that are not parallel meet, at their ends or inside, whatever their directions.

    Pieces meet per cell along them, by classes of equal direction, and only the cell that holds the meeting point reports it. Equal pieces
    are one. Crowded cells are cut up (see _dealt_pieces).
    """
    return _crossings(_dealt_pieces(segments, size))


def _crossings(dealt: DataFrame) -> DataFrame:
    c = F.col
    ax, ay, bx, by = c("a_x2") - c("a_x1"), c("a_y2") - c("a_y1"), c("b_x2") - c("b_x1"), c("b_y2") - c("b_y1")
    turn = ax * by - ay * bx
    turn = F.when(turn != 0, turn)
    gap_x, gap_y = c("b_x1") - c("a_x1"), c("b_y1") - c("a_y1")
    along_a, along_b = (gap_x * by - gap_y * bx) / turn, (gap_x * ay - gap_y * ax) / turn
    met = _meeting_pairs(dealt).select("step", "ix", "iy", along_a.alias("t"), along_b.alias("u"), (c("a_x1") + along_a * ax).alias("x"), (c("a_y1") + along_a * ay).alias("y"))
    inside = F.col("t").between(-1e-9, 1 + 1e-9) & F.col("u").between(-1e-9, 1 + 1e-9)
    # A point next to a border may be worked out on either side of it; which one reports it does not matter.
    step, half = F.col("step"), F.col("step") * (0.5 + 1e-9)
    near = (F.abs(F.col("x") - (F.col("ix") + 0.5) * step) <= half) & (F.abs(F.col("y") - (F.col("iy") + 0.5) * step) <= half)
    return met.where(inside & near).select("x", "y")


def _pieces_at(points: DataFrame, dealt: DataFrame, size: float, reach: float) -> DataFrame:
    """Pieces within `reach` of points: (x, y, x1, y1, x2, y2).

    A point asks per direction found in its cell, for the pieces whose line passes it: lines of one direction are numbered by their
    distance from the cell's corner, in bands of four times the reach.
    """
    cell = ["step", "ix", "iy"]
    ways = dealt.select(*cell, "slope").distinct()
    at = union_all([
        touched_cells(points, F.col("x") - reach, F.col("y") - reach, F.col("x") + reach, F.col("y") + reach, size / _SPLIT**k).withColumn("step", F.lit(float(size) / _SPLIT**k))
        for k in range(_SPLITS + 1)
    ])
    upright = F.col("slope") == F.lit(float("inf"))
    along = F.when(upright, F.lit(0.0)).otherwise(F.lit(1.0) / F.sqrt(F.lit(1.0) + F.col("slope") * F.col("slope")))
    up = F.when(upright, F.lit(1.0)).otherwise(F.col("slope") * along)

    def line(x: str, y: str) -> Column:
        return ((F.col(x) - F.col("ix") * F.col("step")) * up - (F.col(y) - F.col("iy") * F.col("step")) * along) / F.lit(4 * reach)

    asked = at.join(ways, cell).withColumn("band", F.explode(F.sequence(F.floor(line("x", "y") - F.lit(0.5)), F.floor(line("x", "y") + F.lit(0.5)))))
    return asked.join(dealt.withColumn("band", F.floor(line("x1", "y1"))), [*cell, "slope", "band"]).where(
        segment_distance("x", "y", *_END_POINTS) <= reach).select("x", "y", *_END_POINTS)


def network_nodes(segments: DataFrame, min_pieces: int = 3, digits: int = 3, size: float = K.CELL_SIZE_M) -> DataFrame:
    """x, y, pieces: points of a street network, rounded, from which at least `min_pieces` ways lead off.

    The pieces are noded first: every end and every crossing is a point, and a piece leads off in one direction where it ends
    and in two where it passes. Ways in the same direction are one, so pieces that lie on each other count once.

    Everything is worked out where the pieces are: a cell gets the pieces within two of the smallest steps of it and owns the points that are
    rounded into it. Neither crossings nor their ways are shuffled, only pieces, so what moves grows with the streets alone.
    """
    scale, reach = 10.0**digits, 10.0**-digits
    dealt = _dealt_pieces(segments, size, 2 * reach)
    spark = segments.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // _GROUP_ROWS))
    group = F.pmod(F.xxhash64("step", "ix", "iy"), F.lit(groups)).alias("group")
    return dealt.groupBy(group).applyInArrow(cell_nodes(min_pieces, scale, reach), NODE)


# --- nearest features -------------------------------------------------------------------------------------

_FAN_BITS = 4  # every node of the tree has sixteen children
_LEAF = 8  # distinct spots in a leaf
_BROADCAST_LEVELS = 4  # at most 16**4 = 65,536 nodes of a few numbers each
_AXIS_BITS = 30
_RANGE_ROWS = 1 << 19  # rows in a range partition, about
_BLOCK = 1024  # queries in a block, at most
_BLOCK_LEAF = 64  # distinct spots in a leaf that blocks look at
_BLOCK_SPOTS = 8192  # spots that a block would see if both were spread alike
_BLOCK_LEAVES = 1024  # leaves that a block may need before its queries walk by themselves


def _interleaved(value: Column) -> Column:
    """The bits of a number, each followed by an empty one."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return value


def _stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _curve(size, x: str, y: str) -> Column:
    """A row's place along a plane-filling curve. `size` has the least, greatest and quartiles of both columns.

    The axes are stretched around their medians first, so an outlier takes little of them.
    """

    def axis(c: str) -> Column:
        low, high, (q1, middle, q3) = size[f"low_{c}"], size[f"high_{c}"], size[f"q_{c}"]
        unit = max((q3 - q1) / 4, (high - low) * 1e-9, 1e-300)
        stretched = lambda v: math.asinh((v - middle) / unit)
        span = max(stretched(high) - stretched(low), 1e-300)
        share = (F.asinh((F.col(c) - F.lit(middle)) / F.lit(unit)) - F.lit(stretched(low))) / F.lit(span)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * F.lit(float((1 << _AXIS_BITS) - 1))).cast("long")

    return _interleaved(axis(x)).bitwiseOR(F.shiftleft(_interleaved(axis(y)), 1))


def _extent(df: DataFrame, x: str, y: str):
    """One row: the number of rows, and per column the least, the greatest and the quartiles."""
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 1000)
    return df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{c}") for c in (x, y) for name, f in (("low", F.min), ("high", F.max), ("q", quartiles))]).first()


def _ranges(spark, n: int) -> int:
    """Range partitions for n rows: their size does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // _RANGE_ROWS))


def _packed_tree(features: DataFrame, feature_id: str, carry: Sequence[str], k: int, depth: int | None, leaf: int = _LEAF) -> tuple[DataFrame, int] | None:
    """(spots with their leaf, levels of the tree), None without features. Leaves hold equally many distinct spots, however those lie.

    Spots are put in order along a curve that fills the plane and are numbered: `leaf` in a row make a leaf, sixteen leaves in a
    row a node, and so on; a leaf never holds fewer, unless there are fewer. A spot holds at most k features, the ones of the least
    ids, which is all that a search for k can use. A feature without a place is near nothing.
    """
    spot = ["x1", "y1", "x2", "y2"]
    somewhere = features.select(feature_id, *carry, *[F.col(c).cast("double").alias(c) for c in spot]).dropna(subset=spot)
    few = top_n(somewhere, spot, [F.col(feature_id)], k, "_copy").drop("_copy")
    spots = few.groupBy(*spot).agg(F.collect_list(F.struct(feature_id, *carry)).alias("held"), F.count(F.lit(1)).alias("cnt"))
    spark = features.sparkSession
    spots = _stored(spots.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}), "distinct-spots")
    size = _extent(spots, "mx", "my")  # one row: it fixes the axes and the number of levels
    n = size["n"]
    if not n:
        return None
    order = ["code", "mx", "my", *spot]
    ordered = spots.withColumn("code", _curve(size, "mx", "my")).repartitionByRange(_ranges(spark, n), *order).sortWithinPartitions(*order)
    stored = _stored(ordered.withColumn("_at", F.monotonically_increasing_id()).drop("code", "mx", "my"), "spots")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    starts = accumulate([c["n"] for c in counts], initial=0)
    before = spark.createDataFrame([(c["part"], s) for c, s in zip(counts, starts)], "_part long, _before long")
    levels = depth or max(1, math.ceil(math.log(max(n / leaf, 1.0), 1 << _FAN_BITS)))
    leaf_size = max(leaf if depth is None else 1, -(-n // (1 << _FAN_BITS * levels)))
    placed = stored.withColumn("_part", part).join(F.broadcast(before), "_part")
    node = F.least(F.floor((F.col("_before") + row) / F.lit(leaf_size)), F.lit(max(n // leaf_size, 1) - 1)).cast("long")
    return placed.select(node.alias("node"), *spot, "held", "cnt"), levels


def _box_bounds(qx: Column, qy: Column) -> tuple[Column, Column, Column]:
    """(least possible, guaranteed single-feature, greatest possible) distance from a point to a node's box."""
    zero = F.lit(0.0)
    dx = F.greatest(F.col("bx0") - qx, zero, qx - F.col("bx1"))
    dy = F.greatest(F.col("by0") - qy, zero, qy - F.col("by1"))
    fx = F.greatest(F.abs(qx - F.col("bx0")), F.abs(qx - F.col("bx1")))
    fy = F.greatest(F.abs(qy - F.col("by0")), F.abs(qy - F.col("by1")))
    nx = F.least(F.abs(qx - F.col("bx0")), F.abs(qx - F.col("bx1")))
    ny = F.least(F.abs(qy - F.col("by0")), F.abs(qy - F.col("by1")))
    sure = F.least(F.sqrt(nx * nx + fy * fy), F.sqrt(fx * fx + ny * ny))
    return F.sqrt(dx * dx + dy * dy), sure, F.sqrt(fx * fx + fy * fy)


def sphere_bounds(qx: Column, qy: Column) -> tuple[Column, Column, Column]:
    """As _box_bounds, in metres on the sphere, for points and boxes in degrees (x: longitude, not across the date line).

    hav(d) = hav(dlat) + cos(lat1) cos(lat2) hav(dlon): each term is least, and greatest, on its own.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ("bx0", "by0", "bx1", "by1"))
    zero = F.lit(0.0)
    hav = lambda degrees: F.pow(F.sin(F.radians(F.least(degrees, F.lit(180.0))) / 2), 2)
    cos = lambda degrees: F.cos(F.radians(degrees))
    most_cos = F.when((y0 <= 0) & (y1 >= 0), F.lit(1.0)).otherwise(F.greatest(cos(y0), cos(y1)))
    arc = lambda h: F.lit(2.0 * K.EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    near = lambda q, a, b: F.greatest(a - q, zero, q - b)
    far = lambda q, a, b: F.greatest(F.abs(q - a), F.abs(q - b))
    # Longitudes may differ by more than half a turn; the nearer way round is then the other one.
    least_lon = F.least(near(qx, x0, x1), F.greatest(zero, F.lit(360.0) - far(qx, x0, x1)))
    low = arc(hav(near(qy, y0, y1)) + cos(qy) * F.least(cos(y0), cos(y1)) * hav(least_lon))
    high = arc(hav(far(qy, y0, y1)) + cos(qy) * most_cos * hav(far(qx, x0, x1)))
    return low, high, high


def nearest_features(
    queries: DataFrame,
    features: DataFrame,
    k: int = 1,
    query_id: str = "query_id",
    feature_id: str = "feature_id",
    carry: Sequence[str] = (),
    sphere: bool = False,
    depth: int | None = None,
) -> DataFrame:
    """The k nearest features of every query point, exactly: (query_id, feature_id, carry..., distance, rank).

    `queries` has qx, qy; `features` has x1, y1, x2, y2 (equal ends make a point). With `sphere` both are points in degrees
    (x: longitude) and distances are great-circle metres. Features are packed into a tree of boxes whose leaves hold equally many
    distinct spots, in crowds and in empty country alike. Queries are cut into blocks of points that lie together. A block, not a
    query, walks down the tree, and takes along the spots that one of its points may need (see blocks.py); its points and those spots
    meet in one group. Where a block would see too many leaves, its points walk down by themselves. Queries of one id are one;
    one without a place is at no distance from anything, and gets the least ids.
    """
    spots = ["x1", "y1", "x2", "y2", "held"]
    asked = queries.select(query_id, F.col("qx").cast("double").alias("qx"), F.col("qy").cast("double").alias("qy"))
    nowhere = F.col("qx").isNull() | F.col("qy").isNull() | F.isnan("qx") | F.isnan("qy")
    tree = _packed_tree(features, feature_id, carry, k, depth, max(_BLOCK_LEAF, k))
    if tree is None:
        queries_schema = dict(queries.dtypes)
        feature_schema = dict(features.dtypes)
        fields = [f"{query_id} {queries_schema[query_id]}", f"{feature_id} {feature_schema[feature_id]}"]
        fields += [f"{c} {feature_schema[c]}" for c in carry] + ["distance double", "rank int"]
        return features.sparkSession.createDataFrame([], ", ".join(fields))
    placed, levels = tree
    blocks = _query_blocks(asked.where(~nowhere), query_id, placed)
    open_leaves, crowded = _block_leaves(blocks, placed, levels, k, sphere)
    seen = placed.join(open_leaves.select("node").distinct(), "node", "left_semi")
    met = StructType([open_leaves.schema["block"], *[seen.schema[c] for c in (*spots, "cnt")]])
    known = open_leaves.groupBy("node").cogroup(seen.groupBy("node")).applyInArrow(reach_leaf(_probes(sphere), sphere, [*spots, "cnt"]), met)
    q_columns = [query_id, "qx", "qy"]
    light = blocks.join(F.broadcast(crowded), "block", "left_anti")  # at most a block a thousand leaves
    schema = StructType([f for f in light.schema.fields if f.name in q_columns] + [f for f in known.schema.fields if f.name in spots])
    found = light.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(search_block(k, sphere, q_columns, spots), schema)
    if not crowded.isEmpty():  # their points, equal rows once, as often as they came
        alone = blocks.join(F.broadcast(crowded), "block", "left_semi").groupBy(*q_columns).agg(F.count(F.lit(1)).cast("int").alias("_n"))
        alone = alone.withColumn("_point", F.struct(*q_columns, "_n"))
        own = _open_leaves(alone, placed, levels, k, "_point", sphere_bounds if sphere else _box_bounds).join(placed, "node")
        found = found.unionByName(own.select("_point.*", *spots, F.explode(F.sequence(F.lit(1), F.col("_point._n"))).alias("_copy")).drop("_n", "_copy"))
    least = placed.select(*spots, F.array_min(F.transform("held", lambda h: h[feature_id])).alias("_least")).orderBy("_least").limit(k).drop("_least")
    found = found.unionByName(asked.where(nowhere).crossJoin(F.broadcast(least)))

    measure = haversine_m("qy", "qx", "y1", "x1") if sphere else segment_distance("qx", "qy", "x1", "y1", "x2", "y2")
    pairs = found.select(query_id, measure.alias("distance"), F.inline("held"))
    if k == 1:
        best = spread(pairs, query_id).groupBy(query_id).agg(F.min(F.struct("distance", feature_id, *carry)).alias("b"))
        return best.select(query_id, f"b.{feature_id}", *[f"b.{c}" for c in carry], "b.distance", F.lit(1).alias("rank"))
    w = W.partitionBy(query_id).orderBy("distance", feature_id)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, feature_id, *carry, "distance", "rank")


def _query_blocks(queries: DataFrame, query_id: str, placed: DataFrame) -> DataFrame:
    """(query_id, qx, qy, block): points in order along a curve, cut into blocks; fewer points a block where features are many."""
    size = _extent(queries, "qx", "qy")
    n, spots = size["n"], placed.count()
    if not n:
        return queries.withColumn("block", F.lit(0).cast("long"))
    most = max(1, min(_BLOCK, n * _BLOCK_SPOTS // spots))
    order = ["_code", "qx", "qy", "_tie"]
    ordered = queries.withColumns({"_code": _curve(size, "qx", "qy"), "_tie": F.xxhash64(query_id)})
    ordered = ordered.repartitionByRange(_ranges(queries.sparkSession, n), *order).sortWithinPartitions(*order).drop("_code", "_tie")
    return _stored(ordered.mapInArrow(cut_blocks(most), StructType([*ordered.schema.fields, StructField("block", LongType())])), "query-blocks")


def _probe_distance(sphere: bool, probe: str) -> Column:
    """From a probe of a block to a spot."""
    x, y = F.col(f"{probe}x"), F.col(f"{probe}y")
    return haversine_m(y, x, "y1", "x1") if sphere else segment_distance(x, y, "x1", "y1", "x2", "y2")


def _probes(sphere: bool) -> list[str]:
    """Where a block looks from: its four corners, or its middle on the sphere."""
    return ["_m"] if sphere else ["_a", "_b", "_c", "_d"]


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _block_leaves(blocks: DataFrame, placed: DataFrame, levels: int, k: int, sphere: bool) -> tuple[DataFrame, DataFrame]:
    """((block, probes, node): the leaves that a block needs, (block): blocks that would need too many).

    A block goes to one leaf near its middle first. k features there give each corner a limit: what is farther than they are from every
    corner is farther from every point of the block. On the sphere the limit holds from the middle, wider by the block twice.
    """
    around = blocks.groupBy("block").agg(*[f(c).alias(n) for n, f, c in (("_x0", F.min, "qx"), ("_x1", F.max, "qx"), ("_y0", F.min, "qy"), ("_y1", F.max, "qy"))])
    middle = _stored(around.withColumns({"_mx": (F.col("_x0") + F.col("_x1")) / 2, "_my": (F.col("_y0") + F.col("_y1")) / 2}), "block-boxes")
    nodes = _tree_nodes(placed, levels)
    bounds = sphere_bounds if sphere else _box_bounds
    box = F.struct(F.col("node"))
    closest = lambda df: df.groupBy("block", "_mx", "_my").agg(F.min_by(box, F.struct(bounds(F.col("_mx"), F.col("_my"))[0], F.col("node"))).alias("b")).select("block", "_mx", "_my", "b.node")
    first = _descend(spread(middle.select("block", "_mx", "_my"), "block"), nodes, levels, ["block", "_mx", "_my"], closest)
    # The k features nearest to the middle in that leaf, or fewer spots that hold as many.
    t_x, t_y = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length2 = t_x * t_x + t_y * t_y
    t = F.when(length2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("_mx") - F.col("x1")) * t_x + (F.col("_my") - F.col("y1")) * t_y) / length2))).otherwise(F.lit(0.0))
    seen = first.join(placed, "node").select("block", _probe_distance(sphere, "_m").alias("d"), "cnt", (F.col("x1") + t * t_x).alias("px"), (F.col("y1") + t * t_y).alias("py"))
    nearest = W.partitionBy("block").orderBy("d", "px", "py").rowsBetween(W.unboundedPreceding, 0)
    pivots = seen.withColumn("have", F.sum("cnt").over(nearest)).where(F.col("have") - F.col("cnt") < k)
    pivots = pivots.groupBy("block").agg(F.max("have").alias("have"), F.max("d").alias("d"), F.collect_list(F.struct("px", "py")).alias("pivots"))
    ready = middle.join(pivots, "block")
    # Places far from the origin carry fewer digits; limits are that much wider.
    noise = lambda *cs: F.lit(1e-12) * F.greatest(*[F.abs(c) for c in cs]) + F.lit(1e-9)
    corner = {"_a": ("_x0", "_y0"), "_b": ("_x0", "_y1"), "_c": ("_x1", "_y0"), "_d": ("_x1", "_y1"), "_m": ("_mx", "_my")}
    for p in _probes(sphere):
        x, y = (F.col(c) for c in corner[p])
        if sphere:  # from the middle to the farthest point of the block's box
            ready = ready.withColumns({"bx0": F.col("_x0"), "by0": F.col("_y0"), "bx1": F.col("_x1"), "by1": F.col("_y1")})
            limit = F.col("d") + 2 * bounds(x, y)[2] + F.lit(1e-3)
        else:
            limit = F.array_max(F.transform("pivots", lambda v: planar_distance(x, y, v["px"], v["py"]))) + noise(x, y)
        ready = ready.withColumns({f"{p}x": x, f"{p}y": y, f"{p}l": F.when(F.col("have") >= k, limit * F.lit(1.0 + 1e-9))})
    probes = [f"{p}{c}" for p in _probes(sphere) for c in "xyl"]
    ready = _stored(ready.select("block", *probes), "block-probes")

    def reached(df: DataFrame) -> DataFrame:
        near = _any([F.col(f"{p}l").isNull() | (bounds(F.col(f"{p}x"), F.col(f"{p}y"))[0] <= F.col(f"{p}l")) for p in _probes(sphere)])
        return df.where(near).select("block", *probes, "node")

    leaves = _stored(_descend(spread(ready, "block"), nodes, levels, ["block", *probes], reached), "block-leaves")
    crowded = _stored(leaves.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _BLOCK_LEAVES).select("block"), "crowded-blocks")
    return leaves.join(F.broadcast(crowded), "block", "left_anti"), crowded


def _tree_nodes(placed: DataFrame, levels: int) -> dict[int, DataFrame]:
    """Boxes of every level: (node, cnt, bx0, by0, bx1, by1)."""
    nodes = {levels: placed.groupBy("node").agg(
        F.sum("cnt").alias("cnt"), F.min(F.least("x1", "x2")).alias("bx0"), F.min(F.least("y1", "y2")).alias("by0"),
        F.max(F.greatest("x1", "x2")).alias("bx1"), F.max(F.greatest("y1", "y2")).alias("by1"))}
    nodes[levels] = _stored(nodes[levels], "leaves")
    for level in range(levels - 1, 0, -1):
        nodes[level] = nodes[level + 1].groupBy(F.shiftright("node", _FAN_BITS).alias("node")).agg(
            F.sum("cnt").alias("cnt"), F.min("bx0").alias("bx0"), F.min("by0").alias("by0"), F.max("bx1").alias("bx1"), F.max("by1").alias("by1"))
    return nodes


_NODE = ("node", "cnt", "bx0", "by0", "bx1", "by1")


def _descend(seekers: DataFrame, nodes: dict[int, DataFrame], levels: int, own: Sequence[str], prune: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Seekers (columns `own`) beside the leaves that are left when `prune` has looked at the boxes of each level."""
    top = nodes[1].select(F.collect_list(F.struct(*_NODE)).alias("top")).scalar()  # at most 16 boxes
    found = prune(seekers.select("*", F.inline(top)))
    for level in range(2, levels + 1):
        children = nodes[level].select(F.shiftright("node", _FAN_BITS).alias("parent"), *[F.col(c).alias(f"c_{c}") for c in _NODE])
        if level <= _BROADCAST_LEVELS:
            children = F.broadcast(children)
        parents = found.select(*own, F.col("node").alias("parent"))
        found = prune(parents.join(children, "parent").select(*own, *[F.col(f"c_{c}").alias(c) for c in _NODE]))
    return found


def _open_leaves(queries: DataFrame, placed: DataFrame, levels: int, k: int, query_id: str, bounds) -> DataFrame:
    """(query_id, qx, qy, node): the leaves that can hold one of a query's k nearest features."""
    per_query = W.partitionBy(query_id)

    def prune(candidates: DataFrame) -> DataFrame:
        low, sure, high = bounds(F.col("qx"), F.col("qy"))
        if k == 1:
            limit = F.min(sure).over(per_query)
        else:
            candidates = candidates.withColumn("_high", high)
            upto = F.sum("cnt").over(per_query.orderBy("_high", "node").rowsBetween(W.unboundedPreceding, 0))
            candidates = candidates.withColumn("_upto", upto)
            limit = F.min(F.when(F.col("_upto") >= k, F.col("_high"))).over(per_query)
        kept = candidates.withColumn("_limit", limit).where(
            F.col("_limit").isNull() | (low <= F.col("_limit") * F.lit(1.0 + 1e-9)))
        return kept.select(query_id, "qx", "qy", "node")

    return _descend(spread(queries.select(query_id, "qx", "qy"), query_id), _tree_nodes(placed, levels), levels, [query_id, "qx", "qy"], prune)


def inverse_distance(nearest: DataFrame, query_id: str, value: str, power: int = 2) -> DataFrame:
    """Inverse-distance mean over the nearest stations; a station on the spot gives its own value."""
    d = F.col("distance")
    weight = F.when(d > 0, F.lit(1.0) / F.pow(d, F.lit(float(power))))
    return nearest.groupBy(query_id).agg(
        F.coalesce(
            F.min_by(F.when(d == 0, F.col(value)), F.when(d == 0, F.col("rank"))),
            F.sum(weight * F.col(value)) / F.sum(weight),
        ).alias(value)
    )


# --- selections -------------------------------------------------------------------------------------------


def select_in_polygon(cells: DataFrame, x: str, y: str, coords: Sequence[Sequence[float]]) -> DataFrame:
    """Cells whose centroid lies in a drawn polygon. The box test goes first and reaches the scan."""
    xs, ys = [c[0] for c in coords], [c[1] for c in coords]
    boxed = cells.where(F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys)))
    return where_inside(boxed, ring_rows(cells.sparkSession, coords), x, y, cell_side(coords))


def cells_with_fallback(cells: DataFrame, x: str, y: str, coords: Sequence[Sequence[float]], margin: float = 0.002) -> DataFrame:
    """As above; when nothing is selected, every centroid within `margin` of the outline counts."""
    inside = select_in_polygon(cells, x, y, coords)
    if not inside.isEmpty():
        return inside
    return where_near(cells, ring_rows(cells.sparkSession, coords), x, y, max(cell_side(coords), margin), margin)


def mark_in_polygon(cells: DataFrame, x: str, y: str, coords: Sequence[Sequence[float]], name: str = "inside") -> DataFrame:
    """All cells, with a flag for those whose centroid lies in a drawn polygon."""
    return mark_inside(cells, ring_rows(cells.sparkSession, coords), x, y, cell_side(coords), name)


def select_in_named_area(cells: DataFrame, areas: DataFrame, name: str, x: str, y: str, bucket: float) -> DataFrame:
    """Cells in an area of that name, ignoring case; `bucket` is the side of the cells that cover the areas."""
    outlines = areas.where(F.lower("name") == name.lower()).select(F.col("coords").alias("ring")).distinct()
    return where_inside(cells, outlines.withColumn("area", F.md5(F.to_json("ring"))), x, y, bucket, ["area"])


def select_in_radius(cells: DataFrame, lon: str, lat: str, center: tuple[float, float], radius_m: float, exact: bool = False) -> DataFrame:
    """Cells within a radius: planar degrees (111 km each) by default, great-circle with `exact`."""
    cx, cy = F.lit(float(center[0])), F.lit(float(center[1]))
    if not exact:
        return cells.where(planar_distance(cx, cy, lon, lat) <= F.lit(radius_m / 111000.0))
    reach = radius_m / K.M_PER_DEG_LAT * 1.01
    boxed = cells.where(F.col(lat).between(center[1] - reach, center[1] + reach))
    return boxed.where(haversine_m(cy, cx, lat, lon) <= F.lit(float(radius_m)))


def select_by_ids(cells: DataFrame, ids: DataFrame, key: str = "grid_id") -> DataFrame:
    return cells.join(ids.select(key), key, "left_semi")


# --- lattice ----------------------------------------------------------------------------------------------


def lattice_edges(cells: DataFrame, lst: str, stats: DataFrame, weight: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Directed edges to the eight neighbours with distance and heat-weighted cost; `stats` is one row (p60, std).

    Neighbours meet inside tiles: a cell moves once, not once a neighbour.
    """
    here = F.struct(F.col("grid_id").alias("dst"), F.col(lon).alias("tlon"), F.col(lat).alias("tlat"), F.col(lst).alias("_lst"))
    near = neighbours(cells.select("grid_id", lon, lat, lst, "ix", "iy"), here, "iy", "ix")
    sides = F.array_compact(F.array("nw", "n", "ne", "w", "e", "sw", "s", "se"))
    edges = near.select(F.col("grid_id").alias("src"), F.col(lon).alias("slon"), F.col(lat).alias("slat"), F.inline(sides))
    joined = attach_row(edges, "_s", stats).withColumn("distance_m", haversine_m("slat", "slon", "tlat", "tlon"))
    return joined.select("src", "dst", "distance_m", edge_cost("distance_m", "_lst", F.col("_s.p60"), F.col("_s.std"), weight).alias("cost"))
