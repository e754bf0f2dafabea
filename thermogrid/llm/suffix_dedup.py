"""Repeated byte strings of a fixed length, removed wherever they start, by suffix arrays over content shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermogrid.llm import textarrays as T
from thermogrid.llm.packing import PACKED, pack_texts, unpack_texts
from thermogrid.llm.suffixes import permuted_prefixes, suffix_array
from thermogrid.llm.tables import written

_GRAM = 32
_BITS = 24  # of a packed value, for the place in a block
_PIECE = 4 << 20
_BLOCK = 1 << 20
#: Bytes of distinct strings that one suffix array takes, about.
SHARD_BYTES = 1 << 20

_SEGMENT = "key long, digest long, doc_id long, tie long, start long, starts int, inside boolean"


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of string starts whose strings have the same least gram: first start, number of starts, key, digest, inside.

    The least gram (by hash) of a string depends on the string alone, so equal strings get equal keys, wherever they stand.
    `digest` is of all bytes that the run's strings cover. `inside` says that the gram stands there more than once, so that strings of
    one run may be equal. Strings do not cross the offsets.
    """
    gram = min(_GRAM, length)
    width = length - gram + 1
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, bool),)
    sums = T.prefix_hash(data, False)
    n = len(data) - gram + 1
    hashes = T.mix(T.window_hash(sums, gram) + np.uint64(salt))
    low = np.uint64((1 << _BITS) - 1)
    place, high = np.arange(n, dtype=np.uint64), hashes & ~low
    left = (_window_least(high | place, width) & low).astype(np.int64)
    right = (low - (_window_least(high | (low - place), width) & low)).astype(np.int64)
    key = hashes[left]
    begin, end = offsets[:-1], offsets[1:]
    closed = np.zeros(len(data) + 1, np.int32)
    np.add.at(closed, np.maximum(end - length + 1, begin), 1)
    np.add.at(closed, end, -1)
    valid = np.cumsum(closed)[: len(key)] == 0
    change = np.concatenate([[True], (key[1:] != key[:-1]) | ~valid[:-1]])
    first = np.flatnonzero(valid & change)
    last = np.flatnonzero(valid & np.append((key[1:] != key[:-1]) | ~valid[1:], True))
    return first, last - first + 1, key[first].view(np.int64), T.span_hash(sums, first, last + length).view(np.int64), left[first] != right[last]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A very long text in overlapping pieces, so that every string lies whole in exactly one piece's part."""
    if len(data) <= 2 * _PIECE:
        yield 0, data, offsets
        return
    for at in range(0, max(len(data) - length + 1, 1), _PIECE):
        part = data[at : at + _PIECE + length - 1]
        yield at, part, np.array([0, len(part)])


def _segmenter(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, block, bounds in T.text_blocks(b.column(2), _BLOCK):
                for shift, data, offsets in _pieces(block, bounds, length):
                    first, count, key, digest, inside = segments(data, offsets, length)
                    doc = np.searchsorted(offsets, first, "right") - 1
                    rows = pa.array(row + doc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(digest), b.column(0).take(rows), b.column(1).take(rows), pa.array(shift + first - offsets[doc]),
                         pa.array(count.astype(np.int32)), pa.array(inside)],
                        [f.split()[0] for f in _SEGMENT.split(", ")],
                    )

    return cut


def _extractor(length: int):
    """Bytes of the wanted segments of each document; strings of crowded keys are dealt again by another least gram."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            bounds = lists.offsets.to_numpy()
            want = lists.values
            start, count, key, crowded, whole = (want.field(f).to_numpy(zero_copy_only=False) for f in ("start", "starts", "key", "crowded", "whole"))
            out: list[tuple] = []
            for i, text in enumerate(unpack_texts(b.column(2))):
                for j in range(bounds[i], bounds[i + 1]):
                    part = text[start[j] : start[j] + count[j] + length - 1]
                    if not crowded[j]:
                        out.append((i, int(key[j]), int(start[j]), part, bool(whole[j])))
                        continue
                    data = np.frombuffer(part, np.uint8)
                    first, n, sub, _, _ = segments(data, np.array([0, len(data)]), length, salt=1)
                    again = T.combine([np.full(len(sub), key[j]).view(np.uint64), sub.view(np.uint64)]).view(np.int64)
                    out += [(i, k, int(start[j] + f), part[f : f + m + length - 1], bool(whole[j])) for k, f, m in zip(again.tolist(), first.tolist(), n.tolist())]
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), *(pa.array([x[k] for x in out], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()), (4, pa.bool_())))],
                ["doc_id", "tie", "key", "start", "part", "whole"],
            )

    return extract


_STRING = "doc_id long, tie long, key long, start long, whole boolean, digest long"


def _strings(length: int):
    """A digest of each string of the parts."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offsets in T.text_blocks(b.column(4), _BLOCK):
                counts = np.maximum(np.diff(offsets) - length + 1, 0)
                doc = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = offsets[doc] + at
                digest = T.span_hash(T.prefix_hash(data, False), first, first + length).view(np.int64)
                rows = pa.array(row + doc)
                start = b.column(3).take(rows).to_numpy() + at
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(3)), pa.array(start), b.column(5).take(rows), pa.array(digest)], [f.split()[0] for f in _STRING.split(", ")])

    return strings


def _repeats(parts: list[bytes], length: int) -> np.ndarray:
    """For the joined parts with a separator after each: which starts hold a string of that length that starts elsewhere too."""
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int16) + 1
    sizes = np.array([len(p) + 1 for p in parts])
    text[np.cumsum(sizes) - 1] = 0
    before, common = permuted_prefixes(text, suffix_array(text))
    left = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(len(text))  # bytes up to the separator
    long = (common >= length) & (left >= length) & (before >= 0)
    hit = np.zeros(len(text), bool)
    hit[long] = True
    hit[before[long]] = True
    return hit


def _sorter(length: int):
    def sort(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        parts = table.column("part").to_pylist()
        hit = _repeats(parts, length)
        sizes = np.array([len(p) + 1 for p in parts])
        begin = np.cumsum(sizes) - sizes
        edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
        a, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(begin, a, "right") - 1
        wanted = ~table.column("whole").to_numpy()[row]
        a, e, row = a[wanted], e[wanted], row[wanted]
        start = table.column("start").to_numpy()[row] + a - begin[row]
        rows = pa.array(row)
        return pa.table({"doc_id": table.column("doc_id").take(rows), "tie": table.column("tie").take(rows), "start": pa.array(start), "end": pa.array(start + (e - a) + length - 1)})

    return sort


def _cutter(keep_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            bounds = lists.offsets.to_numpy()
            start, end = (lists.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "end"))
            found = []
            for i, text in enumerate(unpack_texts(b.column(1))):
                s, e = start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]]
                order = np.argsort(s)
                s, reach = s[order], np.maximum.accumulate(e[order]) if len(s) else e
                new = np.concatenate([[True], s[1:] > reach[:-1]]) if len(s) else np.zeros(0, bool)
                s, reach = s[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist() if len(s) else []
                kept = b"".join(text[a:b_] for a, b_ in zip([0, *reach], [*s, len(text)]))
                found.append((len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, tie (the text's hash), start, end: byte spans that repeated strings cover; they may overlap.

    1. A text's string starts fall into runs by the least gram of each string (`segments`), a key by content: equal strings meet under one
       key. Keys with one run, whose gram stands there once, cannot repeat and go, after a count with partial sums.
    2. Runs under a key with the same digest are copies: all their bytes repeat, and one of them stands for the rest.
    3. Distinct runs of a key that has several are cut out of the texts and dealt to shards by key. Each shard sorts its
       suffixes by induction and reads off its permuted common prefixes where a string starts more than once.
    4. A key beyond a shard's size is dealt again by a second least gram. What still passes it (a passage shorter than a string, in many
       texts that differ around it) goes to no shard: its strings are counted by key and digest with partial sums, and those
       that start twice are joined back from written tables, where Spark splits a common digest's rows.
    """
    text = F.col(text_col).cast("string")
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    runs = light.mapInArrow(_segmenter(length), _SEGMENT)
    some = runs.groupBy("key").agg(F.count("*").alias("n"), F.max("inside").alias("inside")).where("n > 1 OR inside")
    some = written(some.select("key"), "suffix-keys")
    runs = written(runs.join(some, "key"), "suffix-runs")
    place = F.struct("doc_id", "tie", "start")
    classes = runs.groupBy("key", "digest", "starts").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.max("inside").alias("inside"))
    classes = written(classes, "suffix-classes")
    copies = runs.join(classes.where("n > 1").select("key", "digest", "starts"), ["key", "digest", "starts"])
    copies = copies.select("doc_id", "tie", "start", (F.col("start") + F.col("starts") + F.lit(length - 1)).alias("end"))
    # What one key's distinct runs hold; a key beyond a shard's size is dealt again by a second gram.
    keys = classes.groupBy("key").agg(F.count("*").alias("classes"), F.max("inside").alias("inside"), F.sum(F.col("starts") + F.lit(length)).alias("bytes"))
    keys = written(keys.where("classes > 1 OR inside").select("key", (F.col("bytes") > shard_bytes).alias("crowded"), "bytes"), "suffix-shards")
    sums = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), F.coalesce(F.max("crowded"), F.lit(False)).alias("crowded")).first()
    shards = max(1, -(-sums.total // shard_bytes))
    wanted = classes.join(keys.drop("bytes"), "key").select("at.doc_id", "at.tie", F.struct("at.start", "starts", "key", "crowded", (F.col("n") > 1).alias("whole")).alias("run"))
    wanted = wanted.groupBy("doc_id", "tie").agg(F.collect_list("run").alias("runs"))
    # One of several equal rows is enough to cut the runs from.
    packed = light.mapInArrow(pack_texts, PACKED).alias("p")
    met = packed.join(wanted.alias("w"), F.col("p.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("p.tie") == F.col("w.tie")))
    parts = met.select("p.doc_id", "p.tie", "packed", "runs").mapInArrow(_extractor(length), "doc_id long, tie long, key long, start long, part binary, whole boolean")
    if sums.crowded:
        parts = written(parts, "suffix-parts")
        large = parts.groupBy("key").agg(F.sum(F.octet_length("part")).alias("bytes")).where(F.col("bytes") > shard_bytes).select("key")
        large = written(large, "suffix-large")
        single = parts.join(large, "key", "left_semi").select(*parts.columns).mapInArrow(_strings(length), _STRING)
        single = written(single, "suffix-strings")
        twice = written(single.groupBy("key", "digest").agg(F.count("*").alias("n")).where("n > 1").select("key", "digest"), "suffix-twice")
        found = single.where("NOT whole").join(twice, ["key", "digest"])
        copies = copies.unionByName(found.select("doc_id", "tie", "start", (F.col("start") + F.lit(length)).alias("end")))
        parts = parts.join(large, "key", "left_anti").select(*parts.columns)
    sorted_ = parts.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(_sorter(length), "doc_id long, tie long, start long, end long")
    return copies.unionByName(sorted_)


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, `kept` (binary).

    Every byte covered by a string of `length` bytes that also starts anywhere else in the table, the same document included, goes;
    strings are judged on the input. Matches never cross documents. Null and empty texts have no bytes; each repeated row is a
    document of its own, whose copies are elsewhere; an empty table gives no rows. Cuts may split a character, so what is
    kept is bytes.
    """
    spans = written(repeated_spans(docs, length, id_col, text_col, shard_bytes), "suffix-spans")
    spans = spans.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    text = F.col(text_col).cast("string")
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    packed = light.mapInArrow(pack_texts, PACKED).alias("p")
    met = packed.join(spans.alias("s"), F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.tie") == F.col("s.tie")), "left")
    empty = F.array().cast("array<struct<start: long, end: long>>")
    out = met.select("p.doc_id", "packed", F.coalesce("spans", empty).alias("spans")).mapInArrow(_cutter(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
