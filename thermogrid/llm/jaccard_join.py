"""Near duplicates by Jaccard similarity of word shingles: rare-first prefix join, filtered, verified once per pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from thermogrid.llm import textarrays as T
from thermogrid.llm.components import components
from thermogrid.llm.packing import pack_numbers, unpack_numbers
from thermogrid.llm.tables import written

#: Shingles that one counting task takes, about.
SHARD_SHINGLES = 1_000_000
_LOW = np.uint64((1 << 48) - 1)


def document_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    starts, ends, bounds = T.words(data, offsets)
    words = T.span_hash(T.prefix_hash(data, True), starts, ends)
    n = len(words) - size + 1
    grams = T.combine([words[k : n + k] for k in range(size)]) if n > 0 else words[:0]
    for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - a >= size:
            found = np.sort(grams[a : e - size + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif e > a:
            yield T.combine([words[k : k + 1] for k in range(a, e)])
        else:
            yield words[:0]


def _class_of(found: np.ndarray) -> int:
    """Equal sets have equal classes."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(size: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, classes = [], []
            for _, data, offsets in T.text_blocks(b.column(1)):
                for found in document_shingles(data, offsets, size):
                    counts.append(len(found))
                    classes.append(_class_of(found) if len(found) else None)
            more = range(2, b.num_columns)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(classes, pa.int64()), *(b.column(k) for k in more)],
                ["doc_id", "n_shingles", "class", *(b.schema.names[k] for k in more)],
            )

    return measure


_DEALT = "shard long, block long, classes binary, sizes binary, counts binary, shingles binary"


def _deal(size: int, shards: int):
    """For each block and shard, one row: how many shingles each document of the block has there, and the shingles (48 bits).

    The classes and set sizes of a block travel with one of its rows only.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one partition go once
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for _, data, offsets in T.text_blocks(b.column(1), 4 * T.BLOCK_BYTES):
                sets, classes = [], []
                for found in document_shingles(data, offsets, size):
                    if len(found) and (c := _class_of(found)) not in seen:
                        seen.add(c)
                        sets.append(found)
                        classes.append(c)
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets])
                every = np.concatenate(sets)
                shard = ((every >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
                doc = np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
                shard, doc = shard[order], doc[order]
                low = (every & _LOW)[order].view(np.uint8).reshape(-1, 8)[:, :6]
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                rows = []
                for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
                    names = (np.array(classes, np.int64).tobytes(), pack_numbers(sizes, 4)) if not a else (None, None)
                    rows.append((int(shard[a]), block, *names, pack_numbers(np.bincount(doc[a:e], minlength=len(sets)), 4), low[a:e].tobytes()))
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.binary()) for k in range(6)], [f.split()[0] for f in _DEALT.split(", ")])

    return deal


def _wide(raw: bytes) -> np.ndarray:
    """48-bit values back to 64."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


_SHARED = "block long, classes binary, sizes binary, counts binary, keys binary"


def _shared(table: pa.Table) -> pa.Table:
    """Of one shard: for each block that sent something, the shingles of its documents that others hold as well, each under the number
    of holders (16 bits). A class that several partitions sent counts as several holders, which only loosens the filters."""
    counts = [unpack_numbers(x, 4).astype(np.int64) for x in table.column("counts").to_pylist()]
    shingle = np.concatenate([_wide(x) for x in table.column("shingles").to_pylist()])
    order = np.argsort(shingle)
    ranked = shingle[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    times = np.diff(np.append(first, len(ranked)))
    holders = np.empty(len(shingle), np.uint64)
    holders[order] = np.repeat(np.minimum(times, 65535), times).astype(np.uint64)
    keep = holders > 1
    key = holders << np.uint64(48) | shingle
    rows, at = [], 0
    for c in counts:
        n = int(c.sum())
        mine = keep[at : at + n]
        left = np.bincount(np.repeat(np.arange(len(c)), c)[mine], minlength=len(c))
        rows.append((pack_numbers(left, 4), key[at : at + n][mine].tobytes()))
        at += n
    return pa.table({
        "block": table.column("block"), "classes": table.column("classes"), "sizes": table.column("sizes"),
        "counts": pa.array([r[0] for r in rows], pa.binary()), "keys": pa.array([r[1] for r in rows], pa.binary()),
    })


_RECORD = "class long, n long, alone long, keys binary, prefix array<long>"


def _records(similarity: int):
    """Of one block: a row per class that can have a partner, with its shared shingles in rare-first order and those in its prefix.

    A set of n shingles needs ceil(n * similarity / 100) of them in common with a partner, so two partners share one of their
    first n - that + 1 shingles in any order that both follow. Shingles no one else has come first; only what is left of the
    prefix after those is looked up.
    """

    def records(table: pa.Table) -> pa.Table:
        (named,) = [i for i, x in enumerate(table.column("classes").to_pylist()) if x is not None]
        classes = np.frombuffer(table.column("classes")[named].as_py(), np.int64)
        sizes = unpack_numbers(table.column("sizes")[named].as_py(), 4).astype(np.int64)
        counts = [unpack_numbers(x, 4).astype(np.int64) for x in table.column("counts").to_pylist()]
        owner = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        held = np.bincount(owner, minlength=len(classes))
        prefix = sizes - -(-sizes * similarity // 100) + 1 - (sizes - held)
        wanted = prefix[owner] > 0
        owner, key = owner[wanted], key[wanted]
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[: len(owner)].tolist()
        out = []
        for a, e in zip(cuts, [*cuts[1:], len(owner)]):
            d = int(owner[a])
            out.append((int(classes[d]), int(sizes[d]), int(sizes[d]) - (e - a), key[a:e].tobytes(), key[a : min(e, a + int(prefix[d]))].view(np.int64).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({f.split()[0]: pa.array([r[k] for r in out], kind) for k, (f, kind) in enumerate(zip(_RECORD.split(", "), kinds))})

    return records


def least_difference(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A lower bound of the number of elements that only one of two sorted sets has: both are halved at y's middle, and so on."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    m = len(y) // 2
    p = int(np.searchsorted(x, y[m]))
    found = p < len(x) and x[p] == y[m]
    return least_difference(x[:p], y[:m], depth - 1) + least_difference(x[p + found :], y[m + 1 :], depth - 1) + (not found)


def _verify(similarity: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, na, nc, ka, kc = (b.column(k).to_pylist() for k in range(6))
            linked = []
            for i in range(len(a)):
                x, y = np.frombuffer(ka[i], np.uint64), np.frombuffer(kc[i], np.uint64)
                need = -(-similarity * (na[i] + nc[i]) // (100 + similarity))
                # Suffix filter: what is in one set only may not be too much.
                if na[i] - len(x) + nc[i] - len(y) + least_difference(x, y, 3) > na[i] + nc[i] - 2 * need:
                    continue
                if len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    linked.append(i)
            rows = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows)], ["a", "b"])

    return verify


def _may_link(similarity: int) -> Column:
    """Length, prefix and positional filters on two holders l and r of one shingle; `at` is its place among a set's shared shingles.

    Sets of n and m shingles need `need` in common, so the first one in common is among the first n - need + 1 of one and the first
    m - need + 1 of the other: a pair that links passes at that shingle. Before it they share only shingles that others hold
    too, after it no more than the shorter rest.
    """
    n, m = F.col("l.n"), F.col("r.n")
    most = F.least(F.col("l.at"), F.col("r.at")) + F.least(n - F.col("l.alone") - F.col("l.at"), m - F.col("r.alone") - F.col("r.at"))
    prefix = lambda s: (F.col(f"{s}.n") - F.col(f"{s}.alone") - F.col(f"{s}.at")) * (100 + similarity) >= (n + m) * similarity
    return (F.least(n, m) * 100 >= F.greatest(n, m) * similarity) & prefix("l") & prefix("r") & (most * (100 + similarity) >= (n + m) * similarity)


def _links(pairs: DataFrame, records: DataFrame, similarity: int) -> DataFrame:
    """Each candidate pair once, verified on the shared shingles of both (no other shingle can be in common)."""
    pairs = pairs.distinct()
    sets = records.select("class", "n", "keys")
    left, right = sets.alias("x"), sets.alias("y")
    met = pairs.join(left, pairs.a == F.col("x.class")).join(right, pairs.b == F.col("y.class"))
    return met.select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.keys").alias("ka"), F.col("y.keys").alias("kb")).mapInArrow(_verify(similarity), "a long, b long")


def shingle_sets(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class (equal sets share it; null: empty set)."""
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return light.mapInArrow(_sets(shingle), "doc_id long, n_shingles long, class long")


def class_links(docs: DataFrame, total: int, shingle: int, similarity: int, text_col: str = "text", shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """a, b: verified links between classes of equal sets, enough of them to connect all that are linked.

    Shingles are dealt to shards by hash, and a shard tells each block which of its shingles others hold too. Classes that meet on a prefix shingle
    are compared in two rounds: all with the shingle's shortest holder, and then every two that are not yet connected.
    So a large group of near copies costs one comparison a member, and no pair that could still join two groups is left out.
    """
    shards = max(1, -(-total // shard_shingles))
    light = docs.select(F.lit(0), F.col(text_col).cast("string").alias("text"))
    shared = light.mapInArrow(_deal(shingle, shards), _DEALT).groupBy("shard").applyInArrow(_shared, _SHARED)
    records = shared.groupBy("block").applyInArrow(_records(similarity), _RECORD)
    # Partitions that hold the same class made equal rows of it.
    records = written(records.dropDuplicates(["class"]), "jaccard-records")
    held = records.select("class", "n", "alone", F.posexplode("prefix").alias("at", "key"))
    middle = held.groupBy("key").agg(F.count("*").alias("holders"), F.min(F.struct("alone", "n", "class", "at")).alias("first")).where("holders > 1")
    middle = written(middle.select("key", "first.*"), "jaccard-middle")
    star = held.alias("r").join(middle.alias("l"), "key").where((F.col("l.class") != F.col("r.class")) & _may_link(similarity))
    star = star.groupBy(F.col("r.class").alias("x")).agg(F.min(F.struct("l.alone", "l.n", F.col("l.class").alias("y"))).alias("m")).select("x", "m.y")
    star = star.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pair = [F.least("l.class", "r.class").alias("a"), F.greatest("l.class", "r.class").alias("b")]
    links = written(_links(star, records, similarity), "jaccard-links")
    labels = components(links)
    labelled = held.join(labels, held["class"] == labels.node, "left").select("key", "class", "n", "alone", "at", F.coalesce("component", "class").alias("group"))
    labelled = written(labelled, "jaccard-labelled")
    # Only shingles whose holders are in several groups still need comparing.
    open_keys = written(labelled.groupBy("key").agg(F.min("group").alias("u"), F.max("group").alias("v")).where("u <> v").select("key"), "jaccard-open")
    rest = labelled.join(open_keys, "key")
    cross = rest.alias("l").join(rest.alias("r"), "key").where((F.col("l.class") < F.col("r.class")) & (F.col("l.group") != F.col("r.group")) & _may_link(similarity))
    return links.unionByName(_links(cross.select(*pair), records, similarity))


def _labels(sets: DataFrame, docs: DataFrame, shingle: int, similarity: int, text_col: str, shard_shingles: int) -> DataFrame:
    """node, component for every class that is linked with another."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    return components(class_links(docs, total, shingle, similarity, text_col, shard_shingles))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: int = 75, id_col: str = "doc_id", text_col: str = "text", shard_shingles: int = SHARD_SHINGLES
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links, its own included).

    Two documents link when 100 * shared shingles >= similarity * shingles of either. Shingles are of white space words with A-Z lowered; a
    shorter text is one shingle as a whole; documents without words link with nothing and are their own component. Equal
    sets are one class from the start, so copies are never paired. Repeated rows are copies; a null id takes the least id
    of its component, null if there is none; an empty table gives no rows. Sets and links are compared by 64- and 48-bit hashes.
    """
    sets = written(shingle_sets(docs, shingle, id_col, text_col), "jaccard-sets")
    labels = _labels(sets, docs, shingle, similarity, text_col, shard_shingles)
    least = sets.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, least["class"] == labels.node, "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    # One row per class; a component's least id goes back to its classes, and from there to the documents.
    named = written(named, "jaccard-classes")
    first = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "jaccard-least")
    of_class = written(named.join(first, "component").select("class", "component_id"), "jaccard-ids")
    return sets.join(of_class, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


_PLACE = ["no_id", "id", "t1", "t2"]


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: int = 75, shard_shingles: int = SHARD_SHINGLES
) -> DataFrame:
    """The documents, all columns kept: of each component of near duplicates exactly one row, and every row without words.

    It is the row with the least id (null ids last), ties by hashes of the text, and then of all columns. Rows are told apart by id and text,
    so rows that share an id but are not linked all stay, and of rows without an id a component keeps one at most.
    """
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    hashes = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("t"), text).alias("t2")]
    light = docs.select(id_.alias("doc_id"), text.alias("text"), *hashes)
    sets = written(light.mapInArrow(_sets(shingle), "doc_id long, n_shingles long, class long, t1 long, t2 long"), "jaccard-sets")
    labels = _labels(sets, docs, shingle, similarity, text_col, shard_shingles)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t1", "t2")
    least = sets.where("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("least"))
    named = least.join(labels, least["class"] == labels.node, "left").select("least", F.coalesce("component", "class").alias("component"))
    keep = written(named.groupBy("component").agg(F.min("least").alias("least")).select("least.*"), "jaccard-kept")
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    tie = F.xxhash64(*(docs[c] for c, kind in docs.dtypes if "map<" not in kind)).alias("tie")
    wordless = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) == 0
    packed = docs.select(row, tie, F.coalesce(wordless, F.lit(True)).alias("wordless"), id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).alias("id"), *hashes)
    # Rows of one id and text meet with partial results before they are joined, so many of them are one row per task.
    once = packed.where("NOT wordless").groupBy(*_PLACE).agg(F.min_by("row", "tie").alias("row"))
    kept = once.join(keep, _PLACE, "left_semi").select("row")
    return kept.unionByName(packed.where("wordless").select("row")).select("row.*")
