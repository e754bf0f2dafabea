"""Token ids of documents in Parquet files, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from thermogrid.llm import textarrays as T
from thermogrid.llm.tables import tasks
from thermogrid.llm.vocabularies import byte_bpe

SCHEMA = "doc_id long, part long, before long, n_tokens long, ids array<int>"


def _encoder(file: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, before = byte_bpe(file), TaskContext.get().partitionId(), 0
        for b in batches:
            for first, data, offsets in T.text_blocks(b.column(1)):
                starts, ends = cache.units(data, offsets)
                hashes = T.span_hash(T.prefix_hash(data, False), starts, ends)
                where, size = cache.lookup(hashes, data.tobytes(), starts, ends)
                ids = cache.gather(where, size)
                unit = np.searchsorted(starts, offsets)
                bounds = np.concatenate([[0], np.cumsum(size)])[unit]  # a document's ids begin here
                n = len(offsets) - 1
                out = np.insert(ids.astype(np.int32), bounds[1:], end_id)
                bounds = bounds + np.arange(n + 1)
                count = np.diff(bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), pa.array(np.full(n, part)), pa.array(before + bounds[:-1]), pa.array(count), lists],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(bounds[-1])

    return encode


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes doc_id, part, before (ids of earlier documents in the part), n_tokens and the list `ids` of every whole text.

    Files hold documents in ascending id order (null first, ties by the text's hash), one part after the other. The writer keeps the
    list in dictionary pages (16 bits an id; the second format version turns to delta packing where a dictionary grows too
    large), row groups and pages of the sizes asked for, and a page index, so a reader of a few ids skips the other pages and
    a reader of counts never touches the lists. A null or empty text is the end id alone; an empty table gives an empty file.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(tasks(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    (
        rows.select("doc_id", "text").mapInArrow(_encoder(tokenizer_file, end_id), SCHEMA)
        .write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", 1 << 20).option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(path)
    )


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(2)
        offsets = lists.offsets.to_numpy()
        raw = np.ascontiguousarray(lists.values.to_numpy(), dtype="<u4")
        sums = [zlib.crc32(raw[a:e]) for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written documents with `start`, the number of ids of all documents before it. Only counts are read for it, and only one
    total per part comes to the driver."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted(stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = spark.createDataFrame(list(zip((t.part for t in totals), accumulate((t.n for t in totals), initial=0))), "part long, part_start long")
    return stored.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of read documents, from the ids themselves."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
