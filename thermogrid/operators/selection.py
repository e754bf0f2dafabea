"""The first rows in an order, however many, without sorting: counts of ever finer slices of the key close in on where to cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

__all__ = ["Cut", "cut_of_order"]

_STEP = 12  # bits of the key told apart by one pass; its 4096 counts, at most, come to the driver


@dataclass(frozen=True)
class Cut:
    """Rows in order of (key, id) up to `id` at `key`; `left` of the `held` rows with just that key and id belong to the wanted ones."""

    key: int
    id: object
    left: int
    held: int

    def before(self, key: Column, id_column: str) -> Column:
        """Rows that stand before the last id taken."""
        id_ = F.col(id_column)
        return ((key < F.lit(self.key)) & id_.isNotNull()) | ((key == F.lit(self.key)) & (id_ < F.lit(self.id)))

    def last(self, key: Column, id_column: str) -> Column:
        return (key == F.lit(self.key)) & (F.col(id_column) == F.lit(self.id))


def cut_of_order(df: DataFrame, key: Column, bits: int, id_column: str, wanted: Callable[[int], int]) -> Cut | None:
    """Where the first `wanted(rows)` rows end in the order of (key, id); None if no row is wanted.

    `key` is a whole number from 0 to below 2^bits. Each pass counts one slice of the key by its next 12 bits, which partial sums bring
    down to 4096 rows a task; the last one counts rows by id at one value of the key. That is one group per id, so keys should tell ids apart
    (a random draw does): the ids of one value are ranked in one task. Rows without a key or an id are passed over.
    """
    rows = df.select(key.alias("k"), F.col(id_column).alias("i")).where("k is not null and i is not null")
    shift, prefix, left = bits, 0, None
    while shift > 0:
        step = min(_STEP, shift)
        slice_ = rows.where(F.shiftright("k", shift) == F.lit(prefix)) if left is not None else rows
        shift -= step
        counts = dict(slice_.groupBy(F.shiftright("k", shift).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
        if left is None:
            total = sum(counts.values())
            left = min(wanted(total), total)
            if left <= 0:
                return None
        for prefix in sorted(counts):
            if left <= counts[prefix]:
                break
            left -= counts[prefix]
    ids = rows.where(F.col("k") == F.lit(prefix)).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("i"))
    end = ids.withColumn("u", upto).where(F.col("u") >= F.lit(left)).orderBy("i").first()
    return Cut(prefix, end["i"], left - (end["u"] - end["n"]), end["n"])
