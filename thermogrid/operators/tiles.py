"""Square tiles with a halo: what lies next to a tile's border is copied to its neighbours, so that no window and no key is wider than a tile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thermogrid.session import spread

__all__ = ["TILE", "halo_tiles", "chunked_lines", "neighbours"]

TILE = 64


def _homes(index: str, size: int) -> Column:
    """The tiles along one axis that hold a position: its own, and the next one where it lies at the border."""
    own, at = F.floor(F.col(index) / F.lit(size)).cast("long"), F.pmod(F.col(index), F.lit(size))
    return F.array_compact(F.array(own, F.when(at == 0, own - 1), F.when(at == size - 1, own + 1)))


def halo_tiles(pixels: DataFrame, row: str = "row", col: str = "col", size: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """Every pixel in its tile (`_ty`, `_tx`) and, at the border, in up to three others; `_own` tells which copy is the pixel itself.

    Rows are dealt out by tile, once: windows over (tile, row) and (tile, col) then only sort in place.
    """
    copies = pixels.withColumn("_ty", F.explode(_homes(row, size))).withColumn("_tx", F.explode(_homes(col, size)))
    own = (F.col("_ty") == F.floor(F.col(row) / F.lit(size))) & (F.col("_tx") == F.floor(F.col(col) / F.lit(size)))
    return spread(copies.withColumn("_own", own), *by, "_ty", "_tx")


def chunked_lines(pixels: DataFrame, line: str, index: str, size: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """Lines of pixels in chunks (`_chunk`) that hold the pixel before and after, too."""
    copies = pixels.withColumn("_chunk", F.explode(_homes(index, size)))
    own = F.col("_chunk") == F.floor(F.col(index) / F.lit(size))
    return spread(copies.withColumn("_own", own), *by, line, "_chunk")


def neighbours(pixels: DataFrame, value: str | Column, row: str = "row", col: str = "col", by: Sequence[str] = (), size: int = TILE) -> DataFrame:
    """The eight neighbours of every pixel as columns nw..se, null where there is none; rows go one way, `n` is the row before.

    Pixels need not fill a rectangle. Along a row, a pixel meets the ones beside it; a place without a pixel but with one beside it
    gets a row of its own for this step. Then whole triples meet the rows above and below. All of it happens inside
    tiles: one shuffle of one row a pixel and of the halo, 4 / `size` of it.
    """
    keep = pixels.columns
    tiled = halo_tiles(pixels.withColumn("_v", value if isinstance(value, Column) else F.col(value)), row, col, size, by)
    across, down = W.partitionBy(*by, "_ty", "_tx", row).orderBy(col), W.partitionBy(*by, "_ty", "_tx", col).orderBy(row)
    before, after = F.lag(F.struct(F.col(col).alias("at"), "_v")).over(across), F.lead(F.struct(F.col(col).alias("at"), "_v")).over(across)
    first = tiled.withColumns({"_b": before, "_a": after})
    none = F.when(F.lit(False), F.col("_v"))
    beside = lambda side, away: F.when(F.col(f"{side}.at") == F.col(col) + away, F.col(f"{side}._v"))
    # The triple around the pixel, and around an empty place next to it, which one of its two neighbours in the row gives.
    triple = lambda at, w, m, e: F.struct(F.lit(at).alias("step"), w.alias("w"), m.alias("m"), e.alias("e"))
    gap_after = F.col("_a").isNull() | (F.col("_a.at") != F.col(col) + 1)
    gap_before = F.col("_b").isNull() | (F.col("_b.at") < F.col(col) - 2)
    triples = F.array_compact(F.array(
        triple(0, beside("_b", -1), F.col("_v"), beside("_a", 1)),
        F.when(gap_after, triple(1, F.col("_v"), none, beside("_a", 2))),
        F.when(gap_before, triple(-1, none, none, F.col("_v"))),
    ))
    second = first.withColumn("_t", F.explode(triples)).drop("_a", "_b", "_v")
    second = second.withColumns({col: (F.col(col) + F.col("_t.step")).cast(dict(pixels.dtypes)[col]), "_own": F.col("_own") & (F.col("_t.step") == 0)})
    line = lambda fn: fn(F.struct(F.col(row).alias("at"), "_t")).over(down)
    third = second.withColumns({"_n": line(F.lag), "_s": line(F.lead)}).where("_own")
    part = lambda side, away, name: F.when(F.col(f"{side}.at") == F.col(row) + away, F.col(f"{side}._t.{name}"))
    return third.select(
        *keep, F.col("_t.w").alias("w"), F.col("_t.e").alias("e"),
        part("_n", -1, "w").alias("nw"), part("_n", -1, "m").alias("n"), part("_n", -1, "e").alias("ne"),
        part("_s", 1, "w").alias("sw"), part("_s", 1, "m").alias("s"), part("_s", 1, "e").alias("se"),
    )
