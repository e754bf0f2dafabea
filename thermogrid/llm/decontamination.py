"""Benchmark passages in documents, found with a suffix automaton over the words of all test items."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermogrid.llm import textarrays as T

#: Bytes of benchmark text that one automaton, and the driver at one time, holds. More text makes more passes.
BLOCK_BYTES = 1 << 20
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, with A-Z lowered."""
    return text.translate(_NORMAL).split()


class Automaton:
    """Generalised suffix automaton of items, each a list of words.

    A state stands for all word strings that end at the same places; `link` leads to the state of the longest shorter suffix.
    `home[s]` is the state of the window-long suffix of what `s` holds, and `items[home]` names the items that hold that window.
    An item shorter than the window counts as a whole: `short` marks its state.
    """

    def __init__(self, items: tuple[tuple[str, bytes], ...], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        ids = self.vocabulary
        coded = [(name, [ids.setdefault(w, len(ids)) for w in normal_words(text)]) for name, text in items]
        coded = [(name, ws) for name, ws in coded if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.home = [-1] * len(self.length)
        self.above = [-1] * len(self.length)  # the next marked state up the links
        for s in by_length:
            if self.length[s] >= window:
                up = self.link[s]
                self.home[s] = s if self.length[up] < window else self.home[up]
        for name, ws in coded:
            s = 0
            for i, w in enumerate(ws):
                s = self.next[s][w]
                if i + 1 >= window:
                    self.items.setdefault(self.home[s], set()).add(name)
            if len(ws) < window:
                self.short.setdefault(s, set()).add(name)
        for s in by_length:
            up = self.link[s]
            self.above[s] = up if up in self.short else self.above[up] if up > 0 else -1
        self.least = min((min(len(ws), window) for _, ws in coded), default=0)

    def _copy(self, s: int, length: int) -> int:
        self.next.append(dict(self.next[s]))
        self.length.append(length)
        self.link.append(self.link[s])
        self.link[s] = len(self.length) - 1
        return self.link[s]

    def _target(self, at: int, w: int) -> int:
        """The state that holds exactly (longest string of `at`) + w, split off from a longer one if need be."""
        s = self.next[at][w]
        if self.length[s] == self.length[at] + 1:
            return s
        fresh = self._copy(s, self.length[at] + 1)
        while at >= 0 and self.next[at].get(w) == s:
            self.next[at][w] = fresh
            at = self.link[at]
        return fresh

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._target(last, w)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, at = len(self.length) - 1, last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._target(at, w)
        return new

    def walk(self, ids: list[int], first: int, cover: np.ndarray, found: set[str]) -> None:
        """Streams known words; adds matched spans to `cover` (+1 at a start, -1 after an end) and names to `found`."""
        follow, length, link = self.next, self.length, self.link
        s = matched = 0
        for i, w in enumerate(ids, first):
            while s and w not in follow[s]:
                s = link[s]
                matched = length[s]
            s = follow[s].get(w, 0)
            matched = matched + 1 if s else 0
            if matched >= self.window:
                cover[i - matched + 1] += 1
                cover[i + 1] -= 1
                found |= self.items[self.home[s]]
            m = s if s in self.short and length[s] <= matched else self.above[s]
            while m > 0:
                cover[i - length[m] + 1] += 1
                cover[i + 1] -= 1
                found |= self.short[m]
                m = self.above[m]

    def match(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Words of the text, which of them are hit, and the names of the items found."""
        known = np.fromiter(map(functools.partial(self.vocabulary.get), tokens := normal_words(text), _missing()), np.int64, len(tokens))
        cover, found = np.zeros(len(tokens) + 1, np.int32), set()
        if self.least:
            edge = np.diff(np.concatenate([[0], known >= 0, [0]]).astype(np.int8))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a >= self.least:
                    self.walk(known[a:b].tolist(), a, cover, found)
        return len(tokens), np.cumsum(cover)[:-1] > 0, found


def _missing() -> Iterator[int]:
    while True:
        yield -1


@functools.lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str, bytes], ...], window: int) -> Automaton:
    """Kept between the tasks of one Python worker."""
    return Automaton(items, window)


def item_blocks(bench: DataFrame, limit: int, id_col: str, text_col: str) -> Iterator[tuple[tuple[str, bytes], ...]]:
    """Items in blocks of about `limit` bytes; one block at a time comes to the driver. A null text has no words."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // limit)
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield tuple(sorted({(r.item or "", r.text.encode()) for r in mine.toLocalIterator()}))


def _each_text(column: pa.Array) -> Iterator[bytes]:
    for _, data, offsets in T.text_blocks(column):
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield raw[a:b]


def _finder(items, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, window)
        for b in batches:
            words, spans, names = [], [], []
            for text in _each_text(b.column(1)):
                n, hit, found = automaton.match(text)
                edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
                words.append(n)
                spans.append([{"first": a, "end": e} for a, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                names.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(words, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", "t1", "t2", "n_words", "spans", "items"],
            )

    return find


_FOUND = "doc_id long, t1 long, t2 long, n_words long, spans array<struct<first: long, end: long>>, items array<string>"


def find_contamination(
    docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, `spans` (runs of hit words, end exclusive), n_hit, `items` (names found, sorted), n_items, contaminated.

    A word is hit if it lies in an occurrence of `window` consecutive words of an item, or of a whole shorter item. The automaton tracks
    the longest match that ends at each word, so a hit needs no list of windows. Null or empty texts have no words; items without
    words are never found; repeated documents are documents of their own; no items or no documents are fine.
    An item's name is its id as a string (null: empty).
    """
    text = F.col(text_col).cast("string")
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("t"), text).alias("t2"))
    passes = [light.mapInArrow(_finder(items, window), _FOUND) for items in item_blocks(bench, block_bytes, item_id, item_text)]
    if not passes:
        passes = [light.mapInArrow(_finder((), window), _FOUND)]
    found = passes[0]
    if len(passes) > 1:  # a document's passes meet again; repeated rows come back as often as they were
        for other in passes[1:]:
            found = found.unionByName(other)
        found = found.groupBy("doc_id", "t1", "t2").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows"),
        ).withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / len(passes)).cast("int"))))
        start = F.array_sort("spans")
        empty = F.array().cast("array<struct<first: long, end: long>>")

        def join(done, x):
            last = F.element_at(done, -1)
            touching = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["first"])
            longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
            return F.when(touching, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

        found = found.withColumn("spans", F.aggregate(start, empty, join))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return found.select("doc_id", "n_words", "spans", hit.alias("n_hit"), "items", F.size("items").cast("long").alias("n_items"), (F.size("spans") > 0).alias("contaminated"))


def names_digest(names: F.Column) -> F.Column:
    return F.sha2(F.array_join(names, ","), 256)


def _runs(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of each run of hit words."""
    edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
    return zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())


_SPANS = "t1 long, t2 long, block int, spans array<struct<first: long, end: long>>"


def _marker(items, window: int, block: int):
    """Hit spans of the texts that this block of items hits, under the text's hashes."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, window)
        for b in batches:
            at, spans = [], []
            for i, text in enumerate(_each_text(b.column(2))):
                _, hit, _ = automaton.match(text)
                if hit.any():
                    at.append(i)
                    spans.append([{"first": a, "end": e} for a, e in _runs(hit)])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array([block] * len(at), pa.int32()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                ["t1", "t2", "block", "spans"],
            )

    return mark


def _cutter(items, window: int, text_at: int, least_words: int, most_covered: float):
    """Cuts what the items hit; without items, the spans in the last column, which goes."""

    def hits(b: pa.RecordBatch) -> Iterator[tuple[bytes, int, np.ndarray]]:
        texts = _each_text(b.column(text_at))
        if items is not None:
            automaton = _automaton(items, window)
            for text in texts:
                n, hit, _ = automaton.match(text)
                yield text, n, hit
            return
        for text, spans in zip(texts, b.column(b.num_columns - 1)):
            hit = np.zeros(len(normal_words(text)), bool)
            for x in spans.as_py() or ():
                hit[x["first"] : x["end"]] = True
            yield text, len(hit), hit

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts = [], []
            for i, (text, n, hit) in enumerate(hits(b)):
                if n and hit.sum() > most_covered * n:
                    continue
                keep.append(i)
                if hit.any():
                    data = np.frombuffer(text, np.uint8)
                    starts, ends, _ = T.words(data, np.array([0, len(data)]), spaces_only=False)
                    pieces, at = [], 0
                    for a, e in _runs(hit):
                        if e - a >= least_words:
                            pieces.append(text[at : starts[a]])
                            at = int(ends[e - 1])
                    text = b"".join([*pieces, text[at:]])
                    texts.append(text.decode())
                else:
                    texts.append(b.column(text_at)[i].as_py())
            kept = b.take(pa.array(keep, pa.int64()))
            columns = list(kept.columns)[: None if items is not None else -1]
            columns[text_at] = pa.array(texts, b.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=kept.schema.names[: len(columns)])

    return cut


def decontaminate(
    docs: DataFrame, bench: DataFrame, window: int = 10, least_words: int = 1, most_covered: float = 0.5,
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, all columns kept, without the benchmark's spans.

    A hit span of at least `least_words` words is cut from the first to the last of its words; a document of which more than
    `most_covered` of the words are hit goes. All blocks of a large benchmark are matched on the original text, and a document is
    judged and cut once, by what they hit together: the size of the blocks never changes the result. A null text stays.
    """
    at = docs.columns.index(text_col)
    blocks = item_blocks(bench, block_bytes, item_id, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.mapInArrow(_cutter(first, window, at, least_words, most_covered), docs.schema)
    # Spans depend on the text alone, so copies share one row a block, and a text has at most as many rows as there are blocks.
    text = F.col(text_col).cast("string")
    hashes = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("t"), text).alias("t2")]
    light = docs.select(*hashes, text.alias("text"))
    found = None
    for k, items in enumerate(chain([first, second], blocks)):
        marked = light.mapInArrow(_marker(items, window, k), _SPANS)
        found = marked if found is None else found.unionByName(marked)
    found = found.groupBy("t1", "t2", "block").agg(F.first("spans").alias("spans"))
    found = found.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *hashes)
    spans = "spans"
    while spans in map(str.lower, docs.columns):
        spans += "_"
    met = row.join(found, ["t1", "t2"], "left").select("row.*", F.col("spans").alias(spans))
    return met.mapInArrow(_cutter(None, window, at, least_words, most_covered), docs.schema)
