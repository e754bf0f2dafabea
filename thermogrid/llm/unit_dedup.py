"""Sentences, lines or paragraphs that stand in several places, kept at their earliest place only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermogrid.llm import textarrays as T
from thermogrid.llm.packing import PACKED, pack_texts, unpack_texts
from thermogrid.llm.tables import written

_UNIT = "a long, b long, doc_id long, tie long, start long, end long, seq int, words int"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def _sentence_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a sentence ends before each byte: after a stop and the blanks behind it."""
    blank = _SPACE[data]
    solid = ~blank
    solid[offsets[:-1][offsets[:-1] < len(data)]] = True  # blanks at the start of a text stand behind nothing
    last = np.maximum.accumulate(np.where(solid, np.arange(len(data)), 0))
    ends = np.zeros(len(data), bool)
    ends[1:] = blank[:-1] & ~blank[1:] & _STOP[data[last[:-1]]]
    return ends


def unit_bounds(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of a block: lines with their line end, these cut after sentences, or runs of lines up to and with empty lines."""
    mark = np.zeros(len(data) + 1, bool)
    ends_here = data == 0x0A
    if kind == "paragraphs":
        double = np.zeros(len(data), bool)
        double[1:] = ends_here[1:] & ends_here[:-1]
        ends_here = double & ~np.append(double[1:], False)
    mark[1:] = ends_here
    if kind == "sentences" and len(data):
        mark[:-1] |= _sentence_ends(data, offsets)
    mark[offsets] = True
    marks = np.flatnonzero(mark)
    marks = marks[marks <= len(data)]
    return (marks[:-1], marks[1:]) if len(data) else (marks[:0], marks[:0])


def _units(min_words: int, kind: str):
    """One row per unit of enough words: a 128-bit digest of its words (A-Z lowered, white space apart), its bytes in the text, its number and words."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offsets in T.text_blocks(b.column(2)):
                starts, ends, _ = T.words(data, offsets)
                words = T.span_hash(T.prefix_hash(data, True), starts, ends)
                first, last = unit_bounds(data, offsets, kind)
                at, to = np.searchsorted(starts, first), np.searchsorted(starts, last)
                some = to - at >= max(min_words, 1)
                first, last, at, to = first[some], last[some], at[some], to[some]
                digests = []
                for extra in (np.uint64(0), np.uint64(0x1234567)):
                    sums = T.running_hash(T.mix(words + extra))
                    digests.append(T.span_hash(sums, at, to) ^ T.mix((to - at).astype(np.uint64)))
                doc = np.searchsorted(offsets, first, "right") - 1
                rows = pa.array(row + doc)
                seq = np.arange(len(doc)) - np.searchsorted(doc, doc)
                columns = [*(pa.array(d.view(np.int64)) for d in digests), b.column(0).take(rows), b.column(1).take(rows), pa.array(first - offsets[doc]), pa.array(last - offsets[doc]), pa.array(seq.astype(np.int32)), pa.array((to - at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _UNIT.split(", ")])

    return units


def _cut(run_words: int, lines: bool):
    def passages(units: list[dict]) -> list[list[dict]]:
        """Runs of neighbouring units that all stand elsewhere too, if they have enough words together."""
        runs, at = [], None
        for u in units:
            if at is not None and u["seq"] == at + 1:
                runs[-1].append(u)
            else:
                runs.append([u])
            at = u["seq"]
        return [r for r in runs if sum(u["words"] for u in r) >= run_words]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, removed = [], []
            for text, units in zip(unpack_texts(b.column(1)), b.column(2).to_pylist()):
                found = passages(units)
                spans = [u for r in found for u in r if u["gone"]]
                pieces, at = [], 0
                for s in spans:
                    pieces.append(text[at : s["start"]])
                    at = s["end"]
                kept = b"".join([*pieces, text[at:]])
                if lines and spans and at == len(text) and not text.endswith(b"\n"):
                    kept = kept.removesuffix(b"\n")  # the line before is the last one now
                out.append((len(text), len(found), len(spans), len(text) - len(kept), hashlib.sha256(kept).hexdigest(), kept.decode()))
                removed.append([{"start": s["start"], "end": s["end"]} for s in spans])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)), spans],
                ["doc_id", "n_bytes", "n_passages", "n_removed", "bytes_removed", "kept_sha256", "kept_text", "removed"],
            )

    return cut


def keep_earliest(docs: DataFrame, min_words: int = 1, kind: str = "sentences", run_words: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_passages, n_removed (units), bytes_removed, kept_sha256, kept_text and `removed`, the byte spans taken out.

    Units are sentences (lines, cut after blanks that follow a stop), lines, or paragraphs (up to an empty line), of at least
    `min_words` white space words; equal ones agree in their words with A-Z lowered. A passage is a run of neighbouring units
    that all stand in several places and have at least `run_words` words together (1: every such unit by itself), so that
    a passage is found wherever it begins in a line and however short its lines are, while a lone short sentence
    that happens to repeat stays. Of equal units the one in the least document id (ties by the text's hash, null ids first),
    and there the one that comes first, stays; all others go if they are in a passage. `removed` has offsets into the original
    text, in order; `n_passages` counts first places too. A null or empty text has no units; rows that repeat id and text are
    one place, so all or none of them keep a unit; an empty table gives no rows.

    Repeats are found by an aggregate with partial sums, so a unit that a third of all documents hold meets once per task. Only
    units that stand twice are looked at again, from written tables, where Spark splits a common digest's rows.
    """
    if kind not in ("sentences", "lines", "paragraphs"):
        raise ValueError(f"units are sentences, lines or paragraphs, not {kind}")
    text = F.col(text_col).cast("string")
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    units = written(light.mapInArrow(_units(min_words, kind), _UNIT), "units")
    place = F.struct("doc_id", "tie", "start")
    at = F.xxhash64("doc_id", "tie", "start")
    again = units.groupBy("a", "b").agg(F.min(at).alias("x"), F.max(at).alias("y")).where("x <> y").select("a", "b")
    again = written(units.join(written(again, "units-again"), ["a", "b"]), "units-repeated")
    first = written(again.groupBy("a", "b").agg(F.min(place).alias("first")), "units-first")
    unit = F.struct("seq", "start", "end", "words", (~place.eqNullSafe(F.col("first"))).alias("gone"))
    found = again.join(first, ["a", "b"]).groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set(unit)).alias("units")).alias("g")
    packed = light.mapInArrow(pack_texts, PACKED).alias("p")
    met = packed.join(found, F.col("p.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("p.tie") == F.col("g.tie")), "left")
    units = F.coalesce("units", F.array().cast("array<struct<seq: int, start: long, end: long, words: int, gone: boolean>>"))
    schema = "doc_id long, n_bytes long, n_passages long, n_removed long, bytes_removed long, kept_sha256 string, kept_text string, removed array<struct<start: long, end: long>>"
    return met.select("p.doc_id", "packed", units.alias("units")).mapInArrow(_cut(run_words, kind == "lines"), schema)
