"""Contiguous shards of near equal bytes, from prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from thermogrid.llm.tables import tasks, written


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and, within it, the bytes and rows before each row."""
    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        sizes = b.column("size").to_numpy(zero_copy_only=False)
        after = np.cumsum(sizes) + size
        names = [*b.schema.names, "part", "bytes_before", "rows_before"]
        added = [np.full(len(sizes), part), after - sizes, np.arange(rows, rows + len(sizes))]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(a.astype(np.int64)) for a in added)], names)
        if len(sizes):
            size, rows = int(after[-1]), rows + len(sizes)


def prefix_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, `size` (UTF-8 bytes of the text plus 1), `text_crc32`, `shard` and `slot`.

    Documents stand in ascending id order (null first, ties by checksum and size). Rows are range partitioned once; every partition
    sums its own sizes, the partition totals (one row per partition, added up on the driver) place it in the whole, and a
    document belongs to the shard in whose equal share of all bytes its middle byte lies. So shards are contiguous, and each
    is off its share by no more than the documents at its two ends. `slot` counts a shard's documents from 0.
    A null or empty text has size 1; an empty table gives no rows; repeated rows are documents of their own.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    light = written(light, "shard-sizes")
    order = ["doc_id", "text_crc32", "size"]
    placed = light.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    schema = f"{placed._jdf.schema().toDDL()}, part long, bytes_before long, rows_before long"
    placed = written(placed.mapInArrow(_numbered, schema), "shard-prefix")
    totals = sorted(placed.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    total = sum(t.b for t in totals)
    starts = zip(accumulate((t.b for t in totals), initial=0), accumulate((t.n for t in totals), initial=0))
    offsets = spark.createDataFrame(
        [(t.part, b, n) for t, (b, n) in zip(totals, starts)], "part long, part_bytes long, part_rows long"
    )
    middle = (F.col("bytes_before") + F.col("part_bytes")) * 2 + F.col("size")
    # Twice the middle, times the shards, over twice the total: as decimals, for 8 * 10^14 bytes and thousands of shards.
    share = F.floor(middle.cast("decimal(38,0)") * F.lit(shards).cast("decimal(10,0)") / F.lit(2 * total or 1).cast("decimal(20,0)"))
    placed = placed.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32",
        F.least(share.cast("int"), F.lit(shards - 1)).alias("shard"),
        (F.col("rows_before") + F.col("part_rows")).alias("row"),
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )
