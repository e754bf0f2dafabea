"""Mixing of sources to target weights by the cube method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from thermogrid.llm import textarrays as T
from thermogrid.llm.tables import written

WEIGHTS = (5.0, 2.0, 1.0)
_CHUNK = 1000
_ROW = "doc_id long, source string, tie long, size long, copies int, prob double, source_size long, target double"
_EPS = 1e-9


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [np.diff(T.words(data, offsets)[2]) for _, data, offsets in T.text_blocks(b.column(3))]
        size = np.concatenate(counts) if counts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(size.astype(np.int64))], ["doc_id", "source", "tie", "size"])


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order, null last, take the weights in turn. All targets add up to `share` of all sizes; a target stops at
    `most` times its source's size and the excess goes to the others by weight. The level where that settles is found by one
    pass over the sources in order of the level at which each one stops.
    """
    if not 0 <= share <= most:
        raise ValueError("the share asked for is more than all sources may give")
    # Windows over one row per source.
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.select("*", F.get(F.array(*map(F.lit, weights)), (n - 1) % len(weights)).alias("w"))
    stop = F.col("source_size") * most / F.col("w")
    by = Window.orderBy(stop, F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum(F.col("source_size") * most).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    s = s.select("*", stop.alias("stop"), ((everything * share - full) / left).alias("level"))
    s = s.select("*", F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(Window.partitionBy()).alias("settled"))
    return s.select("source", "source_size", F.least(F.col("source_size") * most, F.coalesce("settled", "stop") * F.col("w")).alias("target"))


def flight(prob: np.ndarray, size: np.ndarray, draw: np.random.Generator, land: bool) -> np.ndarray:
    """Moves the probabilities, keeping their sum and the sum of prob * size, until at most two are fractions.

    Any three fractions have one direction in the null space of the two totals; a random step along it, without change on average,
    takes at least one of them to 0 or 1. `land` settles the last two: first the number of documents is kept and the token total
    let go, then a single one is drawn.
    """
    p, x = prob.tolist(), size.tolist()
    held: list[int] = []
    randoms = iter(draw.random(2 * len(p) + 8).tolist())

    def step(units: list[int], u: tuple[float, ...]) -> None:
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(units, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(units, u) if v)
        move = up if next(randoms) * (up + down) < down else -down
        for i, v in zip(units, u):
            p[i] += move * v
            p[i] = 0.0 if p[i] < _EPS else 1.0 if p[i] > 1 - _EPS else p[i]
        held[:] = [i for i in held if 0 < p[i] < 1]

    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        held.append(i)
        if len(held) == 2 and x[held[0]] == x[held[1]]:
            step(list(held), (1.0, -1.0))
        elif len(held) == 3:
            a, b, c = (x[j] for j in held)
            if a == b == c:
                step(held[:2], (1.0, -1.0))
            else:
                top = float(max(abs(a - b), abs(b - c), abs(c - a)))
                step(list(held), ((c - b) / top, (a - c) / top, (b - a) / top))
    if land:
        if len(held) == 2:
            step(list(held), (1.0, -1.0))
        if held:
            step(list(held), (1.0,))
    return np.array(p)


def _fly(pdf: pd.DataFrame, seed: int, round_no: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["order", "doc_id", "tie"], kind="stable")
    draw = np.random.default_rng([seed & 0xFFFFFFFF, round_no, int(pdf["group"].iloc[0]) & 0x7FFFFFFFFFFFFFFF])
    pdf["prob"] = flight(pdf["prob"].to_numpy(), pdf["size"].to_numpy(), draw, land=int(pdf["chunks"].iloc[0]) == 1)
    return pdf[[c.split()[0] for c in _ROW.split(", ")]]


def cube_mix(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, tie (the text's hash), size (white space words), source_size, target (the source's), copies, taken.

    A source's documents all get target / source_size copies on average: the whole part to each, the fraction as an inclusion
    probability, decided by the cube method with balanced document and token totals. Chunks of about 1000 documents fly on
    their own; each leaves at most two fractions, and those of all chunks of a source fly again until one chunk is left, which
    lands. No task holds a whole source, and a round shrinks the open rows some 500 times.
    Chunks, order and draws depend on ids and texts alone, so reruns agree. Null or empty texts have size 0; a null source is a
    source; repeated rows are documents of their own; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("tie"), text.alias("text"))
    sizes = written(light.mapInArrow(_sizes, "doc_id long, source string, tie long, size long"), "mix-sizes")
    targets = written(source_targets(sizes, share, most, weights), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(ratio - F.round(ratio)) < _EPS, F.round(ratio)).otherwise(ratio)
    rows = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", "d.source", "tie", "size", F.floor(near).cast("int").alias("copies"), (near - F.floor(near)).alias("prob"), "source_size", "target"
    )
    done = rows.where("prob <= 0")
    open_rows, round_no = rows.where("prob > 0"), 0
    while True:
        order = F.xxhash64(F.lit(seed + round_no), "doc_id", "tie")
        counts = open_rows.groupBy("source").agg(F.ceil(F.count("*") / _CHUNK).alias("chunks"))  # one row per source
        flying = open_rows.alias("r").join(counts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.*", "chunks")
        flying = flying.select("*", order.alias("order")).select("*", F.xxhash64("source", F.pmod("order", "chunks")).alias("group"))
        number = round_no
        flown = written(flying.groupBy("group").applyInPandas(lambda pdf: _fly(pdf, seed, number), _ROW), "mix-round")
        done = done.unionByName(flown.where("prob <= 0 or prob >= 1"))
        open_rows, round_no = flown.where("prob > 0 and prob < 1"), round_no + 1
        if open_rows.isEmpty():
            break
    copies = F.col("copies") + F.when(F.col("prob") >= 1, 1).otherwise(0)
    return done.select("doc_id", "source", "tie", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents, all columns kept, each as often as cube_mix takes it. Rows alike in id, text and source share their copies evenly."""
    taken = cube_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken.groupBy("doc_id", "tie", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0").alias("t")
    text = F.col(text_col).cast("string")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.col(source_col).cast("string").alias("source")).alias("p")
    same = F.col("p.id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.tie") == F.col("t.tie")) & F.col("p.source").eqNullSafe(F.col("t.source"))
    met = packed.join(taken, same).select("row", "p.id", "p.tie", "p.source", "copies", "rows")
    alike = met.where("rows > 1").select("*", F.row_number().over(Window.partitionBy("id", "tie", "source").orderBy("tie")).alias("k"))
    share = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("k") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    each = met.where("rows = 1").select("row", F.col("copies").cast("int").alias("times")).unionByName(alike.select("row", share.cast("int").alias("times")))
    return each.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
