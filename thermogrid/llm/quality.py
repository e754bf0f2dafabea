"""Quality rules: how a public vocabulary cuts a text up, against bands of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermogrid.llm import textarrays as T
from thermogrid.llm.tables import written
from thermogrid.llm.vocabularies import pieces

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = ", ".join(f"{c} long" for c in COUNTS) + ", n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string"
#: Scripts by the lead bytes of their letters in UTF-8, fixed values: first and last lead byte.
_SCRIPTS = {"latin": (0xC3, 0xC9), "greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD4), "hebrew": (0xD6, 0xD7), "arabic": (0xD8, 0xDB), "indic": (0xE0, 0xE0), "cjk": (0xE3, 0xE9), "hangul": (0xEA, 0xED)}


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between each bound and the next; bounds may coincide."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def _owner(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys stand there at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def _text_counts(data: np.ndarray, offsets: np.ndarray, starts, ends, bounds, sums) -> list[np.ndarray]:
    n = len(offsets) - 1
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    word_chars = per_document(begins[ends] - begins[starts], bounds)
    symbols = per_document(_SYMBOLS[data], offsets)
    # Lines: cut at every line end and at every document's start.
    mark = np.zeros(len(data) + 1, bool)
    mark[offsets[:-1]] = True
    mark[1:] |= data == 0x0A
    from_, owner_at = np.flatnonzero(mark[:-1]), None
    to = np.append(from_[1:], len(data)) if len(from_) else from_
    last = np.zeros(len(from_), bool)
    if len(from_):
        last = data[to - 1] == 0x0A
    has_word = np.searchsorted(starts, to) > np.searchsorted(starts, from_)
    owner_at = np.searchsorted(offsets, from_, "right") - 1
    line = T.span_hash(sums, from_, to - last) ^ T.mix(owner_at.astype(np.uint64) + np.uint64(1))
    line, owner_at = line[has_word], owner_at[has_word]
    order = np.argsort(line)
    again = np.zeros(len(line), bool)
    if len(line):
        again[order[1:]] = line[order][1:] == line[order][:-1]
    dup_lines = np.bincount(owner_at[again], minlength=n)
    # Words in windows of three that the text holds at least twice.
    words = T.span_hash(sums, starts, ends)
    doc = _owner(bounds)
    repeat = np.zeros(len(words), bool)
    if len(words) > 2:
        inside = doc[2:] == doc[:-2]
        key = T.combine([words[:-2], words[1:-1], words[2:]]) ^ T.mix(doc[:-2].astype(np.uint64) + np.uint64(1))
        hit = np.zeros(len(words) - 2, bool)
        hit[inside] = _twice(key[inside])
        for k in range(3):
            repeat[k : len(words) - 2 + k] |= hit
    return [np.diff(bounds), word_chars, symbols, dup_lines, per_document(repeat, bounds)]


def _scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    names, counts = ["latin"], [per_document(((data | 0x20) >= 97) & ((data | 0x20) <= 122) & (data < 128), offsets)]
    for name, (low, high) in _SCRIPTS.items():
        n = per_document((data >= low) & (data <= high), offsets)
        if name == "latin":
            counts[0] = counts[0] + n
        else:
            names.append(name)
            counts.append(n)
    return [names[i] for i in np.argmax(np.stack(counts), axis=0)]


def _measure(file: str, held: int):
    """Appends the features to the first `held` columns; the text is the last one of the input."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, is_byte = pieces(file)
        vocabulary = np.uint64(len(is_byte))
        for b in batches:
            for first, data, offsets in T.text_blocks(b.column(held)):
                n = len(offsets) - 1
                starts, ends, bounds = T.words(data, offsets)
                sums = T.prefix_hash(data, False)
                counts = _text_counts(data, offsets, starts, ends, bounds, sums)
                where, size = cache.lookup(T.span_hash(sums, starts, ends), data.tobytes(), starts, ends)
                ids = cache.gather(where, size)
                token_bounds = np.concatenate([[0], np.cumsum(size)])[bounds]
                tokens = np.diff(token_bounds)
                bytes_ = per_document(is_byte[ids], token_bounds)
                # Entropy in bits of a document's ids, from the counts of each (document, id).
                pair = np.sort(_owner(token_bounds).astype(np.uint64) * vocabulary + ids)
                new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(pair)))
                spread = np.bincount((pair[new] // vocabulary).astype(np.int64), times * np.log2(np.maximum(times, 1)), minlength=n)
                some = np.maximum(tokens, 1)
                entropy = np.where(tokens > 0, np.log2(some) - spread / some, 0.0)
                added = [*(pa.array(c.astype(np.int64)) for c in (*counts, tokens)), *(pa.array(np.round(x, 4)) for x in (counts[1] / some, bytes_ / some, entropy)), pa.array(_scripts(data, offsets))]
                names = [f.split()[0] for f in _FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, n) for i in range(held)), *added], [*b.schema.names[:held], *names])

    return measure


def measure_quality(docs: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: counts over the whole text and the vocabulary's view of it, beside doc_id, lang and tie (the text's hash).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; n_tokens, chars_per_token, byte_share (tokens that are single bytes) and
    token_entropy (bits). Words go through the vocabulary one by one. A null or empty text has zeros everywhere.
    """
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"), F.col(text_col).cast("string").alias("text"))
    return light.mapInArrow(_measure(vocabulary_file, 3), f"doc_id long, lang string, tie long, {_FEATURES}")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_quality(features: DataFrame, width: float = 2.5) -> DataFrame:
    """Adds base_failed, the reasons and `kept` to written features.

    Bands per language (per script where the language is null) come from all documents that pass the base rules: exact quartiles of the
    rounded features, widened by `width` times their distance and by a small fixed slack. A document is rejected if its
    characters per token leave the band on either side, its byte share is above it, or its entropy is below it. Entropy
    is taken relative to the logarithm of the text's length, as short texts cannot have much of it.
    A language all of whose documents fail has no band, and rejects nobody else.
    """
    key = F.coalesce(F.col("lang"), F.concat(F.lit("script "), F.col("script")))
    even = F.round(F.when(F.col("n_tokens") > 1, F.col("token_entropy") / F.log2(F.col("n_tokens"))).otherwise(0.0), 4)
    rows = features.select("*", key.alias("band"), even.alias("evenness"), base_failed().alias("base_failed"))
    measured = ("chars_per_token", "byte_share", "evenness")
    bands = rows.where(~F.col("base_failed")).groupBy("band").agg(*(F.expr(f"percentile({c}, array(0.25, 0.75))").alias(f"q_{c}") for c in measured))
    # A row per language, and known to be small once written, so that Spark need not gather a language's rows in one place.
    rows = rows.join(written(bands, "quality-bands"), "band", "left")

    def low(c: str, slack: float):
        q = F.col(f"q_{c}")
        return F.col(c) < q[0] - width * (q[1] - q[0]) - slack

    def high(c: str, slack: float):
        q = F.col(f"q_{c}")
        return F.col(c) > q[1] + width * (q[1] - q[0]) + slack

    reasons = F.array_compact(F.array(
        F.when(F.col("base_failed"), F.lit("base")),
        F.when(low("chars_per_token", 0.0) | high("chars_per_token", 0.5), F.lit("fertility")),
        F.when(high("byte_share", 0.02), F.lit("byte fallback")),
        F.when(low("evenness", 0.05), F.lit("entropy")),
    ))
    return rows.select(*features.columns, "base_failed", reasons.alias("reasons"), (F.size(reasons) == 0).alias("kept"))


def quality(docs: DataFrame, vocabulary_file: str, width: float = 2.5, **columns: str) -> DataFrame:
    """Features written once, then judged; see measure_quality and judge_quality."""
    return judge_quality(written(measure_quality(docs, vocabulary_file, **columns), "quality"), width)


def passing(docs: DataFrame, vocabulary_file: str, width: float = 2.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, all columns kept, that quality() keeps. The rejected ones, fewer, are taken away by id and text."""
    verdicts = quality(docs, vocabulary_file, width, id_col=id_col, text_col=text_col, lang_col=lang_col)
    gone = verdicts.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.coalesce("lang", F.lit("")).alias("_lang")).distinct()
    text = F.col(text_col).cast("string")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    # One document in two languages gets a verdict in each.
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")) & (F.col("lang") == F.col("_lang"))
    return packed.join(gone, same, "left_anti").select("row.*")
