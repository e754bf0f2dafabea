"""Ranked lexical search: hashed sketches of maxima bound every score, exact scores follow in descending order of the bounds."""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from thermogrid.llm.sharding import prefix_shards
from thermogrid.llm.tables import scratch_path, written
from thermogrid.llm.textarrays import give_back

#: Bounds of memory, none of which changes a result: bytes of text cut into terms at once, terms counted before they are
#: passed on, coordinates of a sketch, bounds held at once, bytes of items searched in one scan.
SLICE, COUNTED, WIDTH, BOUNDS, ITEM_BYTES = 1 << 20, 1 << 18, 1024, 1 << 21, 1 << 20
#: Bytes that an item counts beside its text, for its column of the lookup table.
ITEM_COST = 256
_SALTS = 32


def _term_bytes() -> bytes:
    """Each byte as terms have it: A-Z lowered; ASCII that is neither letter nor digit parts terms."""
    return bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))


_TERMS = _term_bytes()


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists that cover about SLICE bytes."""
    raw = (text or "").encode().translate(_TERMS)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + SLICE) if len(raw) - at > SLICE else -1
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it, 0) of a task's texts, and the empty term with its documents and their terms."""
    found, docs, total = Counter(), 0, 0

    def rows(counts: Counter, extra: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        names = [*counts, *(e[0] for e in extra)]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([*counts.values(), *(e[1] for e in extra)], pa.int64()), pa.array([*[0] * len(counts), *(e[2] for e in extra)], pa.int64())],
            ["term", "docs", "total"],
        )

    for b in batches:
        for text in b.column(0).to_pylist():
            own, n = set(), 0
            for part in terms(text):
                own.update(part)
                n += len(part)
            found.update(own)
            docs += n > 0
            total += n
            if len(found) > COUNTED:
                yield rows(found, [])
                found = Counter()
    yield rows(found, [(b"", docs, total)])
    give_back()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, names, times = [], [], []
        for i, text in enumerate(b.column(2).to_pylist()):
            counts = Counter()
            for part in terms(text):
                counts.update(part)
            at += [i] * len(counts)
            names += counts
            times += counts.values()
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(3).take(rows), b.column(0).take(rows), b.column(1).take(rows), pa.array(names, pa.binary()), pa.array(times, pa.int64())], ["block", "item", "tie", "term", "times"])


class ItemBlock:
    """Items of one scan: their terms with weights, and how often each coordinate of a sketch counts for each item."""

    def __init__(self, rows: list, n_docs: int, n_terms: int, width: int = WIDTH):
        self.n_docs, self.n_terms, self.width = n_docs, n_terms, width
        docs = {bytes(r.term): r.docs for r in rows}
        self.slot = {t: i for i, t in enumerate(sorted(docs))}
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs[t] + 1))) for t in self.slot], np.int64)
        self.coordinate = np.array([zlib.crc32(t) % width for t in self.slot], np.int64)
        keyed = sorted(((r.item is None, r.item or 0, r.tie), self.slot[bytes(r.term)], r.times) for r in rows)
        self.items = sorted({k for k, _, _ in keyed})
        place = {k: i for i, k in enumerate(self.items)}
        self.owner = np.array([place[k] for k, _, _ in keyed], np.int64)
        self.term, self.times = np.array([t for _, t, _ in keyed], np.int64), np.array([n for _, _, n in keyed], np.int64)
        self.bounds = np.searchsorted(self.owner, np.arange(len(self.items) + 1))

    @functools.cached_property
    def lookup(self) -> np.ndarray:
        """Coordinates by items; a product with sketches gives the bounds of all pairs at once, exactly, since whole numbers stay far below 2^53."""
        table = np.zeros((self.width, len(self.items)))
        np.add.at(table, (self.coordinate[self.term], self.owner), self.times)
        return table

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}


class Best:
    """The k best of each item so far: highest score first, then the least id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # a score must be above 0
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        some = score > 0
        item, score = np.concatenate([self.item, item[some]]), np.concatenate([self.score, score[some]])
        ids, null = np.concatenate([self.id, ids[some]]), np.concatenate([self.null, null[some]])
        order = np.lexsort((ids, null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.item, self.score, self.id, self.null = item[keep], score[keep], ids[keep], null[keep]
        last = place == self.k - 1
        self.least[item[last]] = score[last]


class Batch:
    """Documents with their impacts on the terms of a block: sketches, bounds and exact scores."""

    def __init__(self, block: ItemBlock, counts: list[np.ndarray], lengths: list[int]):
        self.block = block
        owner = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        size = max(len(block.slot), 1)
        self.key, tf = np.unique(owner * size + np.concatenate([*counts, np.zeros(0, np.int64)]), return_counts=True)
        self.doc, self.term = self.key // size, self.key % size
        length = 25 + (75 * np.array(lengths, np.int64) * block.n_docs) // max(block.n_terms, 1)
        self.impact = block.weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[self.doc]))
        self.size, self.docs = size, len(counts)

    def upper(self) -> np.ndarray:
        """An upper bound for every document and item: impacts fold into maxima by hashed coordinate, items look them up together."""
        sketch = np.zeros((self.docs, self.block.width))
        order = np.argsort(self.impact, kind="stable")  # the last write to a coordinate is its maximum
        sketch[self.doc[order], self.block.coordinate[self.term[order]]] = self.impact[order]
        return sketch @ self.block.lookup

    def exact(self, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        first, count = self.block.bounds[item], np.diff(self.block.bounds)[item]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)
        key = np.repeat(doc, count) * self.size + self.block.term[at]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        part = np.where(self.key[place] == key, self.impact[place] * self.block.times[at], 0)
        return np.diff(np.concatenate([[0], np.cumsum(part)])[np.concatenate([[0], ends])])

    def search(self, best: Best, ids: np.ndarray, null: np.ndarray, first_look: int = 16) -> int:
        """Scores pairs exactly in descending order of their bounds until no bound reaches the item's threshold; returns how many."""
        if not len(self.key):
            return 0
        upper = self.upper()
        doc, item = np.nonzero(upper >= best.least)
        bound = upper[doc, item]
        order = np.lexsort((-bound, item))
        doc, item, bound = doc[order], item[order], bound[order]
        scored, look = 0, first_look
        while len(doc):
            now = np.arange(len(item)) - np.searchsorted(item, item) < look
            best.add(item[now], self.exact(doc[now], item[now]), ids[doc[now]], null[doc[now]])
            scored += int(now.sum())
            rest = ~now & (bound >= best.least[item])
            doc, item, bound, look = doc[rest], item[rest], bound[rest], look * 2
        return scored


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: ItemBlock = shared.value
        best = Best(len(block.items), k)
        most = max(1, BOUNDS // max(len(block.items), block.width))
        ids, null, counts, lengths = [], [], [], []

        def look() -> None:
            Batch(block, counts, lengths).search(best, np.array(ids, np.int64), np.array(null, bool))
            for x in (ids, null, counts, lengths):
                x.clear()

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, known = 0, []
                for part in terms(text):
                    n += len(part)
                    slots = np.fromiter(map(block.slot.get, part, itertools.repeat(-1)), np.int64, len(part))
                    known.append(slots[slots >= 0])
                known = np.concatenate([*known, np.zeros(0, np.int64)])
                if len(known):
                    ids.append(i or 0)
                    null.append(i is None)
                    counts.append(known)
                    lengths.append(n)
                if len(counts) >= most:
                    look()
        if counts:
            look()
        item = [block.items[i] for i in best.item.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if x[0] else x[1] for x in item], pa.int64()), pa.array([x[2] for x in item], pa.string()), pa.array(best.id, mask=best.null), pa.array(best.score)],
            ["item", "tie", "doc", "score"],
        )
        give_back()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, first within salted parts, since an item has k rows a task."""
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    parts = Window.partitionBy("item", "tie", "salt").orderBy(*order)
    some = found.withColumn("salt", F.pmod(F.hash("doc"), F.lit(_SALTS))).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "tie").orderBy(*order))).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The k documents with the highest scores above 0 for each item: item_id, rank (from 1), doc_id, score.

    Scores are saturated term frequencies with length normalisation, times a logarithmic weight, in whole numbers. One scan counts the
    documents of each term and keeps the items' terms only. A second one folds each document's impacts into a sketch of
    `width` maxima, bounds all scores of a batch by one product, and scores pairs exactly in descending order of the bounds
    until they fall below the item's k-th score. A task sends k rows an item at most.

    Items come to the driver, and are broadcast, in blocks of about `block_bytes` of text (one item may be longer), one after the other;
    each block is one scan, whose cost is far below that of scoring thousands of items. More items mean more scans, never
    a larger broadcast.

    Null or empty texts have no terms: such documents are not counted and never found, such items give no rows. Items that agree
    in id and text are one item, items of one id with different texts are ranked apart; repeated documents are documents of
    their own; equal scores go by ascending id, null ids last. Long texts are cut into terms slice by slice. Other columns are
    left out, whatever their names; empty tables give no rows.
    """
    spark = docs.sparkSession
    light = docs.select(F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    tie = F.sha2(F.concat_ws(":", F.coalesce(F.col("item").cast("string"), F.lit("-")), "text"), 256)
    asked = written(asked.select("item", tie.alias("tie"), "text"), "search-items")
    total = asked.agg(F.sum(F.octet_length("text") + ITEM_COST)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = _in_blocks(asked, blocks)
    wanted = written(dealt.mapInArrow(_item_terms, "block int, item long, tie string, term binary, times long"), "search-terms")
    some = wanted.select("term").union(spark.createDataFrame([(bytearray(),)], "term binary")).distinct()
    counts = light.mapInArrow(_count, "term binary, docs long, total long").join(written(some, "search-vocabulary"), "term", "left_semi")
    counts = written(counts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")), "search-counts")
    whole = counts.where(F.octet_length("term") == 0).first()
    if whole is None:  # no documents at all
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weighted = written(wanted.join(counts.select("term", "docs"), "term"), "search-weights")
    path = scratch_path(spark, "search-found")
    schema = "item long, tie string, doc long, score long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for n in range(blocks):
        rows = weighted.where(F.col("block") == n).collect()
        if rows:
            shared = spark.sparkContext.broadcast(ItemBlock(rows, whole.docs, whole.total, width))
            del rows
            texts.mapInArrow(_searcher(shared, k), schema).write.mode("append").parquet(path)
            shared.destroy()
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    best = _ranked(spark.read.schema(schema).parquet(path), k)
    return best.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def _in_blocks(asked: DataFrame, blocks: int) -> DataFrame:
    """(item, tie, text, block): contiguous blocks with equal bytes of text."""
    if blocks == 1:
        return asked.withColumn("block", F.lit(0))
    padded = F.concat("text", F.repeat(F.lit("."), ITEM_COST - 1))
    shard = prefix_shards(asked.select("tie", padded.alias("text")), blocks, "tie").select(F.col("doc_id").alias("tie"), F.col("shard").alias("block"))
    return asked.join(shard, "tie").select("item", "tie", "text", "block")
