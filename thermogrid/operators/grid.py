"""Grid generation and how much of each cell polygons cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thermogrid import constants as K
from thermogrid.functions import ring_turn
from thermogrid.session import spread

__all__ = ["lattice", "polygon_coverage", "polygon_overlap_per_cell", "generate_grid"]


def lattice(bounds: DataFrame, size: float = K.CELL_SIZE_M) -> DataFrame:
    """Cells of the bounding box (minx, miny, maxx, maxy), numbered x-outer, y-inner from 1.

    Columns of the lattice come from one row and are spread over the cluster before each grows its cells.
    """
    s = F.lit(float(size))
    nx = F.ceil((F.col("maxx") - F.col("minx")) / s).cast("long")
    ny = F.ceil((F.col("maxy") - F.col("miny")) / s).cast("long")
    columns = bounds.select("minx", "miny", ny.alias("_ny"), F.explode(F.sequence(F.lit(0).cast("long"), nx - 1)).alias("ix"))
    cells = spread(columns, "ix").withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ny") - 1)))
    return cells.select(
        (F.col("ix") * F.col("_ny") + F.col("iy") + 1).alias("grid_id"), "ix", "iy",
        (F.col("minx") + F.col("ix") * s).alias("left"), (F.col("miny") + F.col("iy") * s).alias("bottom"),
        (F.col("minx") + (F.col("ix") + 1) * s).alias("right"), (F.col("miny") + (F.col("iy") + 1) * s).alias("top"),
    )


def _edge(ring: str, fn, axis: str) -> Column:
    return fn(F.transform(ring, lambda p: p[axis]))


def _outline_pieces(polygons: DataFrame, size: float, by: Sequence[str]) -> DataFrame:
    """Edges of rings cut at cell borders: (by..., iy, ix, xa, ya, xb, yb, way), positions within the cell.

    `way` is -1 where the polygon's inside lies to the right of a rising edge, 1 where it lies to the left; level edges bound no area.
    """
    s = F.lit(float(size))
    flag = F.when(F.col("hole"), F.lit(-1)).otherwise(F.lit(1))
    closed = polygons.where(F.size("ring") >= 3).select(*by, (-ring_turn("ring") * flag).alias("way"), F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))
    ends = F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"))
    edge = closed.select(*by, "way", F.inline(ends))
    edge = edge.select(*by, "way", *[F.col(f"{p}.{c}").cast("double").alias(f"{c}{k}") for p, k in (("a", 1), ("b", 2)) for c in "xy"])
    edge = edge.where((F.col("y1") != F.col("y2")) & (F.col("way") != 0))

    def steps(low: Column, high: Column) -> Column:
        first = F.floor(low / s).cast("long")
        return F.explode(F.sequence(first, F.greatest(first, F.ceil(high / s).cast("long") - 1)))

    def at(axis: Column, start: str, end: str, other_start: str, other_end: str) -> Column:
        """The other coordinate where the edge is at `axis`, exact at its two ends."""
        share = (axis - F.col(start)) / (F.col(end) - F.col(start))
        between = F.col(other_start) + share * (F.col(other_end) - F.col(other_start))
        return F.when(axis == F.col(start), F.col(other_start)).when(axis == F.col(end), F.col(other_end)).otherwise(between)

    def clamp(value: str, low: Column) -> Column:
        return F.greatest(low, F.least(low + s, F.col(value)))

    row = edge.withColumn("iy", steps(F.least("y1", "y2"), F.greatest("y1", "y2")))
    bottom = F.col("iy") * s
    row = row.withColumns({"ya": clamp("y1", bottom), "yb": clamp("y2", bottom)})
    row = row.withColumns({"xa": at(F.col("ya"), "y1", "y2", "x1", "x2"), "xb": at(F.col("yb"), "y1", "y2", "x1", "x2"), "ya": F.col("ya") - bottom, "yb": F.col("yb") - bottom})
    cell = row.select(*by, "way", "iy", "xa", "ya", "xb", "yb", steps(F.least("xa", "xb"), F.greatest("xa", "xb")).alias("ix"))
    left = F.col("ix") * s
    cell = cell.withColumns({"p": clamp("xa", left), "q": clamp("xb", left)})
    level = F.col("xa") == F.col("xb")
    return cell.select(
        *by, "iy", "ix", "way", (F.col("p") - left).alias("xa"), (F.col("q") - left).alias("xb"),
        F.when(level, F.col("ya")).otherwise(at(F.col("p"), "xa", "xb", "ya", "yb")).alias("ya"),
        F.when(level, F.col("yb")).otherwise(at(F.col("q"), "xa", "xb", "ya", "yb")).alias("yb"),
    )


def polygon_coverage(polygons: DataFrame, size: float = K.CELL_SIZE_M, by: Sequence[str] = ()) -> DataFrame:
    """Area and first moments per cell for rings (column `ring`, optional flag `hole`): (by..., ix, iy, area, mx, my).

    By Green's theorem an edge knows the area on its right, so each piece of an outline adds its share to the cell that it runs through
    and a band as high as the piece to all cells further right in that row. Shares add up, over rings too, before anything is
    shuffled; running sums along a row of cells then give the rest, and the stretches without an outline are filled in. Nothing is
    clipped; a window holds at most one entry per cell of a row. Moments are about the cell's lower left corner. Cells of less than
    1e-10 of a full one are left out: rounding may put them on either side of an edge.
    """
    s = F.lit(float(size))
    if "hole" not in polygons.columns:
        polygons = polygons.withColumn("hole", F.lit(False))
    xa, ya, xb, yb = (F.col(c) for c in ("xa", "ya", "xb", "yb"))
    rise = F.col("way") * (yb - ya)
    share = _outline_pieces(polygons, size, by).groupBy(*by, "iy", "ix").agg(
        F.sum(rise).alias("band"),
        F.sum(rise * (ya + yb) / 2).alias("band_y"),
        F.sum(rise * (s - (xa + xb) / 2)).alias("area"),
        F.sum(rise * (s * s - (xa * xa + xa * xb + xb * xb) / 3) / 2).alias("mx"),
        F.sum(rise * (s * (ya + yb) / 2 - (2 * xa * ya + xa * yb + xb * ya + 2 * xb * yb) / 6)).alias("my"),
    )
    row = W.partitionBy(*by, "iy").orderBy("ix")
    before = row.rowsBetween(W.unboundedPreceding, -1)
    run = share.select(
        "*", F.lead("ix").over(row).alias("next"),
        F.coalesce(F.sum("band").over(before), F.lit(0.0)).alias("b"), F.coalesce(F.sum("band_y").over(before), F.lit(0.0)).alias("by_"),
    )

    def filled(b: Column, b_y: Column) -> list[Column]:
        return [s * b, s * s / 2 * b, s * b_y]

    own = [F.col(c) + f for c, f in zip(("area", "mx", "my"), filled(F.col("b"), F.col("by_")))]
    after = filled(F.col("b") + F.col("band"), F.col("by_") + F.col("band_y"))
    inner = F.when((after[0] > s * s * 1e-10) & (F.col("next") > F.col("ix") + 1), F.sequence(F.col("ix") + 1, F.col("next") - 1)).otherwise(F.array().cast("array<bigint>"))
    pack = lambda x, values: F.struct(x.alias("ix"), *[v.alias(n) for n, v in zip(("area", "mx", "my"), values)])
    cells = F.concat(F.array(pack(F.col("ix"), own)), F.transform(inner, lambda x: pack(x, after)))
    return run.select(*by, "iy", F.inline(cells)).where(F.col("area") > s * s * 1e-10).select(*by, "ix", "iy", "area", "mx", "my")


def polygon_overlap_per_cell(polygons: DataFrame, size: float = K.CELL_SIZE_M, by: Sequence[str] = ()) -> DataFrame:
    """Overlap area per cell for polygon rings (column `ring`; an optional flag `hole` takes area away)."""
    return polygon_coverage(polygons, size, by).select("ix", "iy", *by, "area")


def generate_grid(boundary: DataFrame, size: float = K.CELL_SIZE_M) -> DataFrame:
    """Cells of a one-row boundary table (column `ring`): id, true area after the clip, centroid.

    Ids count the whole bounding lattice, x outer and y inner, before the clip, so they have holes.
    """
    s = F.lit(float(size))
    origin = boundary.withColumns({
        "minx": _edge("ring", F.array_min, "x"), "miny": _edge("ring", F.array_min, "y"), "maxy": _edge("ring", F.array_max, "y"),
    })
    shifted = origin.select(
        "minx", "miny", F.ceil((F.col("maxy") - F.col("miny")) / s).cast("long").alias("ny"),
        F.transform("ring", lambda p: F.struct((p["x"] - F.col("minx")).alias("x"), (p["y"] - F.col("miny")).alias("y"))).alias("ring"),
    )
    return polygon_coverage(shifted, size, ["minx", "miny", "ny"]).select(
        (F.col("ix") * F.col("ny") + F.col("iy") + 1).alias("grid_id"), "ix", "iy", F.col("area").alias("area_m2"),
        (F.col("mx") / F.col("area") + F.col("ix") * s + F.col("minx")).alias("cx"), (F.col("my") / F.col("area") + F.col("iy") * s + F.col("miny")).alias("cy"),
    )
