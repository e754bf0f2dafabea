"""Rasters as pixel tables: zonal statistics, resampling, sampling, neighbourhoods, terrain."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thermogrid import constants as K
from thermogrid.operators.keyed import attach_row, keep_first, union_all
from thermogrid.operators.stats import quantile_columns
from thermogrid.operators.tiles import chunked_lines, neighbours

__all__ = [
    "zonal_statistics", "circular_mean", "majority_class", "pixels_to_cells", "resample_nearest", "sample_at_points",
    "merge_tiles", "neighbours", "slope_aspect", "hillshade", "fill_nodata", "pad_edges", "aspect_direction", "qa_summary",
]


def pixels_to_cells(pixels: DataFrame, x: str, y: str, size: float = K.CELL_SIZE_M, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Attach the cell a pixel's centre falls in: arithmetic, no geometry and no shuffle."""
    s = F.lit(float(size))
    return pixels.withColumns({
        "ix": F.floor((F.col(x) - F.lit(x0)) / s).cast("long"), "iy": F.floor((F.col(y) - F.lit(y0)) / s).cast("long"),
    })


def zonal_statistics(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return pixels.where(v.isNotNull()).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("pixels")
    )


def circular_mean(degrees) -> Column:
    """Aggregate: mean direction in 0..360. With no rows at all the arctangent of nothing is 0, as it was."""
    r = F.radians(F.col(degrees) if isinstance(degrees, str) else degrees)
    angle = F.degrees(F.atan2(F.coalesce(F.sum(F.sin(r)), F.lit(0.0)), F.coalesce(F.sum(F.cos(r)), F.lit(0.0))))
    return F.pmod(angle, F.lit(360.0))


def majority_class(pixels: DataFrame, keys: Sequence[str], class_column: str, classes: Sequence[int]) -> DataFrame:
    """Most frequent class per cell (lowest code on ties) and the share of each listed class in percent."""
    counts = pixels.where(F.col(class_column).isNotNull()).groupBy(*keys, class_column).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    shares = [
        (F.coalesce(F.sum(F.when(F.col(class_column) == k, F.col("c"))), F.lit(0)) / total * F.lit(100.0)).alias(f"share_{k}")
        for k in classes
    ]
    return counts.groupBy(*keys).agg(F.min_by(class_column, F.struct(-F.col("c"), F.col(class_column))).alias("majority"), *shares)


def resample_nearest(pixels: DataFrame, factor: int) -> DataFrame:
    """Split each coarse pixel (row, col) into factor x factor fine pixels with the same value."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = pixels.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps))
    return out.withColumns({"row": F.col("row") * factor + F.col("_r"), "col": F.col("col") * factor + F.col("_c")}).drop("_r", "_c")


def sample_at_points(points: DataFrame, raster: DataFrame, x: str, y: str, origin: tuple[float, float], step: tuple[float, float], shape: tuple[int, int], value: str) -> DataFrame:
    """Raster value under each point (floor index); points off the raster stay with null."""
    col = F.floor((F.col(x) - F.lit(origin[0])) / F.lit(step[0])).cast("long")
    row = F.floor((F.col(y) - F.lit(origin[1])) / F.lit(step[1])).cast("long")
    inside = (row >= 0) & (row < shape[0]) & (col >= 0) & (col < shape[1])
    keyed = points.withColumns({"row": F.when(inside, row), "col": F.when(inside, col)})
    return keyed.join(raster.select("row", "col", value), ["row", "col"], "left")


def merge_tiles(tiles: Sequence[DataFrame], nodata: float | None = None) -> DataFrame:
    """Mosaic of tiles; where they overlap the first tile with data wins."""
    tagged = [t.withColumn("_tile", F.lit(i)) for i, t in enumerate(tiles)]
    pixels = union_all(tagged)
    pixels = pixels.where(F.col("value").isNotNull() & (F.col("value") != F.lit(nodata)) if nodata is not None else F.col("value").isNotNull())
    return keep_first(pixels, ["row", "col"], ["_tile"]).drop("_tile")


def _gradients(cell_x: float, cell_y: float) -> tuple[Column, Column]:
    c = F.col
    dzdx = ((c("ne") + F.lit(2.0) * c("e") + c("se")) - (c("nw") + F.lit(2.0) * c("w") + c("sw"))) / F.lit(8.0 * cell_x)
    dzdy = ((c("sw") + F.lit(2.0) * c("s") + c("se")) - (c("nw") + F.lit(2.0) * c("n") + c("ne"))) / F.lit(8.0 * cell_y)
    return dzdx, dzdy


def slope_aspect(pixels: DataFrame, value: str, cell_x: float, cell_y: float, by: Sequence[str] = ()) -> DataFrame:
    """Slope in degrees and aspect in 0..360 clockwise from north (-1 flat), third-order differences.

    Pixels without a full neighbourhood get null; pad_edges fills them.
    """
    near = neighbours(pixels, value, by=by)
    dzdx, dzdy = _gradients(cell_x, cell_y)
    sloped = near.withColumns({"dzdx": dzdx, "dzdy": dzdy})
    slope = F.degrees(F.atan(F.hypot("dzdx", "dzdy")))
    aspect = F.pmod(F.lit(90.0) - F.degrees(F.atan2(F.col("dzdy"), -F.col("dzdx"))), F.lit(360.0))
    return sloped.select(
        *pixels.columns, "dzdx", "dzdy", slope.alias("slope"),
        F.when(slope <= 1e-6, F.lit(-1.0)).otherwise(aspect).alias("aspect"),
    )


def hillshade(gradients: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """0..255 illumination from the gradients of slope_aspect."""
    slope = F.atan(F.hypot("dzdx", "dzdy"))
    aspect = F.radians(F.pmod(F.lit(90.0) - F.degrees(F.atan2(F.col("dzdy"), -F.col("dzdx"))), F.lit(360.0)))
    zenith, toward = math.radians(90.0 - altitude), math.radians(360.0 - azimuth + 90.0)
    lit = F.lit(math.cos(zenith)) * F.cos(slope) + F.lit(math.sin(zenith)) * F.sin(slope) * F.cos(F.lit(toward) - aspect)
    shade = F.when(lit < 0, F.lit(0.0)).when(lit > 1, F.lit(1.0)).otherwise(lit) * F.lit(255.0)
    return gradients.withColumn("hillshade", shade)


def _filled_along(pixels: DataFrame, line: str, index: str, by: Sequence[str]) -> DataFrame:
    """Holes filled from the pixel before, then from the one after."""
    ends = pixels.groupBy(*by, line).agg(
        F.min(index).alias("lo"), F.max(index).alias("hi"), F.min_by("filled", index).alias("first"), F.max_by("filled", index).alias("last"))
    beyond = F.array(
        F.struct((F.col("lo") - 1).alias(index), F.col("last").alias("filled")), F.struct((F.col("hi") + 1).alias(index), F.col("first").alias("filled")))
    wrapped = ends.select(*by, line, F.inline(beyond)).withColumn("_real", F.lit(False))
    chunks = chunked_lines(pixels.withColumn("_real", F.lit(True)).unionByName(wrapped, allowMissingColumns=True), line, index, by=by)
    w = W.partitionBy(*by, line, "_chunk").orderBy(index)
    chunks = chunks.withColumn("filled", F.coalesce("filled", F.lag("filled").over(w)))
    chunks = chunks.withColumn("filled", F.coalesce("filled", F.lead("filled").over(w)))
    return chunks.where("_own AND _real").select(*pixels.columns)


def fill_nodata(pixels: DataFrame, value: str, rounds: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Fill holes from the left, right, upper and lower neighbour, each pass seeing the last; the edge wraps.

    What is still empty takes the median. A line may begin and end anywhere but has no gaps. Lines are worked on in chunks that know
    the pixel before and after; each line's two ends, one row a line, stand beyond the other end once more.
    """
    out = pixels.withColumn("filled", F.col(value))
    for _ in range(rounds):
        for line, index in (("row", "col"), ("col", "row")):
            out = _filled_along(out, line, index, by)
    (median,) = quantile_columns(out, "filled", [0.5])
    return out.withColumn("filled", F.coalesce(F.col("filled"), median))


def pad_edges(pixels: DataFrame, columns: Sequence[str], shape_of: DataFrame | None = None) -> DataFrame:
    """Border pixels take the value of the nearest interior pixel."""
    extent = (shape_of if shape_of is not None else pixels).agg(
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    keep, x = pixels.columns, F.col("_x")

    def clamp(name: str, low: Column, high: Column) -> Column:
        return F.greatest(low + 1, F.least(high - 1, F.col(name)))

    on_edge = (F.col("row") == x["r0"]) | (F.col("row") == x["r1"]) | (F.col("col") == x["c0"]) | (F.col("col") == x["c1"])
    marked = attach_row(pixels, "_x", extent)
    inner = marked.where(~on_edge)
    border = marked.where(on_edge).drop(*columns).withColumns({
        "_r": clamp("row", x["r0"], x["r1"]), "_c": clamp("col", x["c0"], x["c1"]),
    })
    source = inner.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *columns)
    return inner.select(*keep).unionByName(border.join(source, ["_r", "_c"], "left").select(*keep))


def aspect_direction(aspect) -> Column:
    a = F.col(aspect) if isinstance(aspect, str) else aspect
    names = F.array(*[F.lit(d) for d in K.ASPECT_DIRECTIONS])
    index = F.floor(F.pmod(a + F.lit(22.5), F.lit(360.0)) / F.lit(45.0)).cast("int")
    return F.when(a == -1.0, F.lit("Flat")).when(a.isNotNull(), F.element_at(names, index + 1))


def qa_summary(pixels: DataFrame, qa: str, by: Sequence[str] = ()) -> DataFrame:
    """Masked and valid pixel counts and fractions; below half valid the scene is of low quality."""
    from thermogrid.functions import qa_masked, round_even

    counts = pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("total_pixels"), F.count_if(qa_masked(qa)).alias("cloud_masked_pixels"))
    total, masked = F.col("total_pixels"), F.col("cloud_masked_pixels")
    valid = round_even((total - masked) / total, 4)
    return counts.select(
        *by, "total_pixels", "cloud_masked_pixels", (total - masked).alias("valid_pixels"),
        valid.alias("valid_pixel_fraction"), round_even(masked / total, 4).alias("cloud_fraction"),
        F.when(valid < 0.5, F.lit("low_quality")).otherwise(F.lit("ok")).alias("quality_flag"),
    )
