from __future__ import annotations

import math
import re
from collections import Counter

import public_tokenizers
import sentencepiece

from thermogrid.llm.quality import judge_quality, measure_quality, quality

FILE = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, model):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    twice = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    ids = [t for w in ws for t in model.encode(w)]
    times = Counter(ids).values()
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in times)
    share = sum(map(model.is_byte, ids)) / max(len(ids), 1)
    chars = sum(map(len, ws))
    return (len(ws), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), len(ids)), (chars / max(len(ids), 1), share, entropy)


def test_against_brute_force(odd_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    got = measure_quality(odd_docs, FILE).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        counts, reals = brute(texts[r.doc_id], model)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens) == counts, r
        assert all(abs(a - b) < 1e-4 for a, b in zip((r.chars_per_token, r.byte_share, r.token_entropy), reals)), r


def test_verdicts(spark, odd_docs):
    good = [(i, " ".join(f"{a} {b}" for a, b in zip("the of and to in is that for it with".split() * 9, f"model house river{i} garden winter letter music".split() * 13)), "en") for i in range(40)]
    bad = [(100, " ".join(f"{chr(0x13000 + i)}{chr(0x13100 + i)}" for i in range(60)), "en"), (101, " ".join(f"q{i * 7919 % 99991}zx{i}" for i in range(90)), "en"), (102, None, "en"), (103, "few words", None)]
    docs = spark.createDataFrame([(i, f"{t} n{i}" if t else t, lang) for i, t, lang in good + bad], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality(docs, FILE).collect()}
    assert got[102].base_failed and got[103].base_failed and not got[102].kept
    assert not got[100].kept and "byte fallback" in got[100].reasons
    assert not got[101].kept
    again = {r.doc_id: r for r in quality(docs.repartition(7), FILE).collect()}
    assert again == got


def test_empty_table(no_docs):
    assert quality(no_docs, FILE).count() == 0
    assert judge_quality(measure_quality(no_docs, FILE)).count() == 0
