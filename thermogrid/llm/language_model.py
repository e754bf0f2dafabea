"""A smoothed word bigram model held as Elias-Fano tries in shards, and the log probability of every text under it."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from thermogrid.llm import textarrays as T
from thermogrid.llm.elias_fano import BigramTrie
from thermogrid.llm.packing import pack_numbers, unpack_numbers
from thermogrid.llm.tables import written

HELD_OUT = 2
FOLDS = 7
#: Weight of the lower order, in counts.
MU = 200.0
BLOCK_BYTES = 8 << 20
#: Entries of block vocabularies, and token pairs, that one shard takes, about.
VOCABULARY_SHARD = 500_000
PAIR_SHARD = 1_000_000
_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN_ID = np.uint64((1 << 40) - 1)
_UNKNOWN = np.uint64((1 << 40) - 2)
#: Counts up to 31 as they are, larger ones on 224 steps up to 2^40.
_STEPS = np.concatenate([np.arange(32), np.round(32 * 2.0 ** (np.arange(1, 225) * 35 / 224))]).astype(np.int64)
_MIDDLE = np.concatenate([np.arange(32), np.sqrt(_STEPS[31:-1].astype(float) * _STEPS[32:])])


def _count_code(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(_STEPS, counts), 255)


def in_held_out(doc_id: int | None, folds: int = FOLDS, fold: int = HELD_OUT) -> bool:
    """By the id's decimal text (null: no text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


_BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths binary, tokens binary, vocabulary binary, counts binary, entries long, n_tokens long, n_train long, train_docs long"


def _blocks(folds: int, fold: int):
    """A row per block of documents: tokens as places in the block's own sorted vocabulary of word hashes, and its counts in training texts."""

    def row(number: int, ids: list, tokens: list[np.ndarray], lengths: list[np.ndarray]) -> pa.RecordBatch:
        tokens, lengths = np.concatenate(tokens), np.concatenate(lengths)
        held = np.array([in_held_out(i, folds, fold) for i in ids])
        order = np.argsort(tokens)
        ranked = tokens[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        place = np.empty(len(tokens), np.uint32)
        place[order] = np.cumsum(new) - 1
        train = np.repeat(~held, lengths)
        counts = np.bincount(place[train], minlength=int(new.sum()))
        values = (number, ids, held.tolist(), pack_numbers(lengths, 5), pack_numbers(place, 4), ranked[new].tobytes(), pack_numbers(counts, 5),
                  len(counts), len(tokens), int(train.sum()), int((~held).sum()))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in _BLOCK.split(", ")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, tokens, lengths = TaskContext.get().partitionId() << 32, 0, [], [], []
        for b in batches:
            for first, data, offsets in T.text_blocks(b.column(1)):
                starts, ends, bounds = T.words(data, offsets)
                tokens.append(np.insert(T.span_hash(T.prefix_hash(data, True), starts, ends), bounds[1:], _END))
                lengths.append(np.diff(bounds) + 1)
                ids += b.column(0).slice(first, len(offsets) - 1).to_pylist()
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield row(number, ids, tokens, lengths)
                    number, size, ids, tokens, lengths = number + 1, 0, [], [], []
        if ids:
            yield row(number, ids, tokens, lengths)

    return blocks


def _send_words(shards: int):
    """Slices of the blocks' vocabularies by the top bits of the hash."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, counts in zip(*(b.column(k).to_pylist() for k in range(3))):
                words, counts = np.frombuffer(words, np.uint64), unpack_numbers(counts, 5)
                shard = ((words >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cuts]), pa.array([block] * len(cuts)), pa.array([words[a:e].tobytes() for a, e in spans], pa.binary()), pa.array([pack_numbers(counts[a:e], 5) for a, e in spans], pa.binary())],
                    ["shard", "block", "words", "counts"],
                )

    return send


_ANSWER = "shard long, block long, counts binary, ids binary, known long"


def _count_words(shards: int):
    """Of one shard: every word's count and id for each block that asked, and the number of training words (in a row of block -1).

    Ids go down by count within a shard, so frequent words have small ones. A word that no training text holds has none.
    """

    def count(table: pa.Table) -> pa.Table:
        shard, blocks = table.column("shard")[0].as_py(), table.column("block").to_pylist()
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        every, counts = np.concatenate(words), np.concatenate([unpack_numbers(x, 5) for x in table.column("counts").to_pylist()])
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        total = np.add.reduceat(counts[order], first)
        vocabulary = ranked[first]
        rank = np.empty(len(total), np.uint64)
        rank[np.lexsort((vocabulary, -total.astype(np.int64)))] = np.arange(len(total), dtype=np.uint64)
        ids = np.where(total > 0, rank * np.uint64(shards) + np.uint64(shard), _UNKNOWN)
        place = np.empty(len(every), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(every))))
        rows, at = [(shard, -1, b"", b"", int((total > 0).sum()))], 0
        for block, mine in zip(blocks, words):
            p = place[at : at + len(mine)]
            rows.append((shard, block, pack_numbers(total[p], 5), pack_numbers(ids[p], 5), 0))
            at += len(mine)
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("shard", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("ids", pa.binary()), ("known", pa.int64())))})

    return count


class _Block:
    """A block with what the whole corpus says about its words."""

    def __init__(self, row: dict, train_docs: int):
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.lengths = unpack_numbers(row["lengths"], 5).astype(np.int64)
        tokens = unpack_numbers(row["tokens"], 4).astype(np.int64)
        answers = sorted(row["answers"], key=lambda x: x["shard"])
        counts = np.concatenate([unpack_numbers(x["counts"], 5) for x in answers]).astype(np.int64)
        ids = np.concatenate([unpack_numbers(x["ids"], 5) for x in answers])
        self.count, self.word = counts[tokens], ids[tokens]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        begins = np.cumsum(self.lengths) - self.lengths
        self.context, self.context_count = np.roll(self.word, 1), np.roll(self.count, 1)
        self.context[begins], self.context_count[begins] = _BEGIN_ID, train_docs
        #: Pairs that a training text may hold; the others are scored on the spot.
        self.asked = np.flatnonzero((self.count > 0) & (self.context_count > 0))
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        place = rank[tokens]
        before = np.roll(place, 1)
        before[begins] = len(ids)
        self.pair = (before * (len(ids) + 1) + place)[self.asked]

    def distinct(self, shards: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The asked pairs, each distinct one once, by shard, context and word: a token that has it and its shard; and of each asked token its pair's place."""
        _, first, of = np.unique(self.pair, return_index=True, return_inverse=True)
        at = self.asked[first]
        context = self.context[at]
        key = np.where(self.context_count[at] > hot, T.combine([context, self.word[at]]), T.mix(context + np.uint64(1)))
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return at[order], shard[order], place[of]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _send_pairs(shards: int, train_docs: int, hot: int):
    """Messages of a block's distinct (context, word) pairs with their counts in its training texts; a context with more than `hot` pairs is spread over all shards by the word."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            k = _Block(row, train_docs)
            at, shard, of = k.distinct(shards, hot)
            train = np.bincount(of[~k.held[k.doc[k.asked]]], minlength=len(at))
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))[: len(at)]
            out = []
            for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                p = at[a:e]
                c = k.context[p]
                first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                out.append((
                    int(shard[a]), row["block"], pack_numbers(c[first], 5), pack_numbers(k.context_count[p[first]], 5), pack_numbers(np.diff(np.append(first, len(p))), 4),
                    pack_numbers(k.word[p], 5), pack_numbers(_count_code(k.count[p]), 1), pack_numbers(train[a:e], 5),
                ))
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [f.split()[0] for f in _PAIRS.split(", ")])

    return send


_PAIRS = "shard long, block long, contexts binary, context_counts binary, repeats binary, words binary, codes binary, train binary"
_VALUES = "shard long, block long, levels binary, values binary"


def _score_pairs(tokens: int, vocabulary: int, mu: float):
    """Of one shard: builds the trie from the pairs of training texts, asks it for the pairs of all, and answers each block pair by pair.

    A block sends a pair once, so a shard has no more entries of one pair than there are blocks.
    """

    def score(table: pa.Table) -> pa.Table:
        column = lambda n, w: [unpack_numbers(x, w) for x in table.column(n).to_pylist()]
        contexts, repeats, words = column("contexts", 5), column("repeats", 4), column("words", 5)
        every = np.concatenate(contexts)
        known, at = np.unique(every, return_inverse=True)
        context_count = np.zeros(len(known), np.int64)
        context_count[at] = np.concatenate(column("context_counts", 5))
        context = np.repeat(at, np.concatenate(repeats).astype(np.int64))
        # Pairs in order, each distinct one once.
        key = context.astype(np.uint64) << np.uint64(40) | np.concatenate(words)
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        pair = ranked[new]
        seen = np.add.reduceat(np.concatenate(column("train", 5)).astype(np.int64)[order], np.flatnonzero(new))
        of = (pair >> np.uint64(40)).astype(np.int64)
        lower = (_MIDDLE[np.concatenate(column("codes", 1)).astype(np.int64)][order[new]] + 1) / (tokens + vocabulary + 1)
        total = context_count[of] + mu
        word = pair & np.uint64((1 << 40) - 1)
        held_by = seen > 0
        trie = BigramTrie.build(known[of[held_by]], word[held_by], np.log10((seen + mu * lower) / total)[held_by])
        there, stored = trie.query(known[of], word)
        levels, level = np.unique(np.where(there, stored, np.log10(mu * lower / total)), return_inverse=True)
        level, out, a = level[place], [], 0
        for block, w in zip(table.column("block").to_pylist(), words):
            mine, code = np.unique(level[a : a + len(w)], return_inverse=True)
            out.append((block, levels[mine].tobytes(), pack_numbers(code, 4)))
            a += len(w)
        shard = table.column("shard").slice(0, 1).to_pylist() * len(out)
        return pa.table({"shard": pa.array(shard, pa.int64()), "block": pa.array([r[0] for r in out], pa.int64()), "levels": pa.array([r[1] for r in out], pa.binary()), "values": pa.array([r[2] for r in out], pa.binary())})

    return score


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(tokens: int, vocabulary: int, train_docs: int, mu: float, shards: int, hot: int):
    """Per document: the counts and the base score, and the shards' values of its pairs with what needed no shard."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            k, n = _Block(row, train_docs), len(row["doc_ids"])
            plain = np.log10(k.count + 1) - math.log10(tokens + vocabulary + 1)
            # A context that training texts lack leaves the lower order; a word that they lack leaves its share of it.
            lower = np.where(k.context_count > 0, plain + np.log10(mu / (k.context_count + mu)), plain)
            if len(k.asked):
                parts = sorted(row["parts"], key=lambda x: x["shard"])
                values = np.concatenate([np.frombuffer(x["levels"])[unpack_numbers(x["values"], 4).astype(np.int64)] for x in parts])
                lower[k.asked] = values[k.distinct(shards, hot)[2]]
            score = np.bincount(k.doc, lower, minlength=n)
            values = (k.doc_ids, k.held, k.lengths, np.bincount(k.doc, k.count > 0, minlength=n).astype(np.int64), np.bincount(k.doc, plain, minlength=n), score)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], [f.split()[0] for f in _SCORES.split(", ")])

    return finish


def score_texts(
    docs: DataFrame, mu: float = MU, folds: int = FOLDS, fold: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text",
    vocabulary_shard: int = VOCABULARY_SHARD, pair_shard: int = PAIR_SHARD,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the documents that are not held out, scores all. Tokens are white space words with A-Z lowered and one end per text (null:
    empty, so the end alone). The unigram is add-one smoothed with one place for all unknown words, which is also the base;
    p(word | context) = (pairs + mu * p(word)) / (contexts + mu), the context of a first word being the text's beginning.

    1. Blocks of documents are written as places in their own vocabularies. 2. Vocabulary slices meet in shards by hash, which
    return counts and dense ids. 3. Blocks send each distinct pair once with its training count to shards by context, those of very
    frequent contexts by word as well; a shard holds its part of the model as an Elias-Fano trie in memory-mapped levels and
    answers with a value per pair, which the block adds up by document: a pair has no more entries than there are blocks.
    The model is never in one place, and every table that moves grows in proportion to the corpus. Repeated rows are
    documents of their own and count as often; an empty table gives no rows.
    """
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(light.mapInArrow(_blocks(folds, fold), _BLOCK), "lm-blocks")
    sums = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entries", "n_tokens", "n_train", "train_docs"))).first()
    shards = max(1, -(-sums.entries // vocabulary_shard))
    sent = blocks.select("block", "vocabulary", "counts").mapInArrow(_send_words(shards), "shard long, block long, words binary, counts binary")
    answers = written(sent.groupBy("shard").applyInArrow(_count_words(shards), _ANSWER), "lm-words")
    vocabulary = answers.where("block < 0").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    per_block = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "counts", "ids")).alias("answers"))
    met = blocks.select("block", "doc_ids", "held", "lengths", "tokens").join(per_block, "block")
    shards = max(1, -(-sums.n_tokens // pair_shard))
    hot = max(1, sums.n_train // (4 * shards))
    pairs = met.mapInArrow(_send_pairs(shards, sums.train_docs, hot), _PAIRS)
    scored = pairs.groupBy("shard").applyInArrow(_score_pairs(sums.n_train, vocabulary, mu), _VALUES)
    parts = scored.groupBy("block").agg(F.collect_list(F.struct("shard", "levels", "values")).alias("parts"))
    out = met.join(parts, "block", "left").mapInArrow(_finish(sums.n_train, vocabulary, sums.train_docs, mu, shards, hot), _SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(sums.n_train).cast("long").alias("train_tokens"), "base_score", "score")
