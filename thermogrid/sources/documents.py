"""Large JSON documents read in parallel: byte ranges of one file, scanned for strings and brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

__all__ = ["split_members"]

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _after(piece: str, inside: bool) -> tuple[bool, int]:
    """(inside a string?, change of depth) after a piece and the closing brace that ended it."""
    if inside:
        end = _REST.match(piece).end()
        if end == len(piece):
            return True, 0
        piece = piece[end + 1 :]
    bare = _STRING.sub("", piece)
    open_ = bare.find('"')
    if open_ >= 0:
        bare = bare[:open_]
    depth = bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
    return open_ >= 0, depth if open_ >= 0 else depth - 1


def _split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file and split, what it does to a reader that comes in outside a string, and to one that comes in inside."""
    states: dict[tuple[str, int], list] = {}
    for b in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in b.columns)):
            state = states.setdefault((file, block), [False, 0, True, 0])
            for k in (0, 2):
                state[k], change = _after(piece, state[k])
                state[k + 1] += change
    rows = [(f, k, *s) for (f, k), s in states.items()]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "block", "out_in", "out_depth", "in_in", "in_depth"])


def _member_start(text: str, depth: int, level: int) -> int:
    """Where the last object begins that lies `level` deep."""
    at = 0
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t in "{[":
            depth += 1
            if t == "{" and depth == level:
                at = m.start()
        elif t in "}]":
            depth -= 1
    return at


def _members(level: int):
    """Whole objects of a split, and the parts of objects that reach over its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "block", "part", "text"])

        for b in batches:
            out = []
            for file, block, inside, depth, piece in zip(*(c.to_pylist() for c in b.columns)):
                # [inside a string, depth, pieces, depth where these begin, do they begin within an object that began before?]
                state = held.setdefault((file, block), [inside, depth, [], depth, depth >= level])
                state[0], change = _after(piece, state[0])
                before, state[1] = state[1] + change + 1, state[1] + change
                state[2].append(piece + "}")
                if not state[0] and before == level and state[1] == level - 1:
                    text = "".join(state[2])
                    if state[4]:
                        out.append((file, block, 1, text))
                    else:
                        out.append((file, block, 0, text[_member_start(text, state[3], level) :]))
                    state[2:] = [[], state[1], False]
            yield batch(out)
        ends = []
        for (file, block), (_, depth, pieces, first, begun) in held.items():
            if pieces and depth >= level:
                text = "".join(pieces)
                ends.append((file, block, 1, text) if begun else (file, block, 2, text[_member_start(text, first, level) :]))
        yield batch(ends)

    return run


def split_members(spark: SparkSession, path: str, level: int = 3) -> DataFrame:
    """(file, text): the objects that lie `level` deep in JSON documents, e.g. the features of a FeatureCollection, as they are written.

    A document is read in byte ranges like any text, records ending at closing braces, so one large file makes many tasks. A first
    scan tells what each range does to depth and quotation whichever way it is entered; these effects, a row a range, are
    put one after the other on the driver and give each range its start. The second scan cuts the objects out; what
    reaches over the end of a range is put together from its parts. An object is held whole by one task, nothing larger is.
    """
    records = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = records.mapInArrow(_split_effects, "file string, block long, out_in boolean, out_depth long, in_in boolean, in_depth long")
    starts, file, inside, depth = [], None, False, 0
    for r in sorted(effects.collect()):
        if r.file != file:
            file, inside, depth = r.file, False, 0
        starts.append((r.file, r.block, inside, depth))
        inside, depth = (r.in_in, depth + r.in_depth) if inside else (r.out_in, depth + r.out_depth)
    table = spark.createDataFrame(starts, "file string, block long, inside boolean, depth long")
    # A row a range: far smaller than any range.
    entered = records.join(F.broadcast(table), ["file", "block"]).select("file", "block", "inside", "depth", "value")
    found = entered.mapInArrow(_members(level), "file string, block long, part int, text string")
    # At most two parts a range: the rest of an object (1), then the start of the next one (2).
    begun = F.count_if(F.col("part") == 2).over(W.partitionBy("file").orderBy("block", "part"))
    parts = found.where("part > 0").withColumn("object", begun).groupBy("file", "object").agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
    return found.where("part = 0").select("file", "text").unionByName(parts.select("file", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
