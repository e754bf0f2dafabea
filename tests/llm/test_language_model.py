from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from samples import prose, thue_morse

from thermogrid.llm.language_model import MU, in_held_out, score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, BEGIN = ("end",), ("begin",)


def brute(rows):
    texts = [(i, in_held_out(i), [*WORD.findall((t or "").translate(LOW)), END]) for i, t in rows]
    one, two = Counter(), Counter()
    for _, held, ws in texts:
        if not held:
            one.update(ws)
            two.update(zip([BEGIN, *ws], ws))
    context = Counter()
    for (a, _), n in two.items():
        context[a] += n
    total, size, out = sum(one.values()), len(one), []
    for i, held, ws in texts:
        lower = [(one[w] + 1) / (total + size + 1) for w in ws]
        score = sum(math.log10((two[a, w] + MU * p) / (context[a] + MU)) if context[a] else math.log10(p) for a, w, p in zip([BEGIN, *ws], ws, lower))
        out.append((i, held, len(ws), sum(one[w] > 0 for w in ws), total, sum(map(math.log10, lower)), score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"vocabulary_shard": 40, "pair_shard": 150}])
def test_against_brute_force(spark, odd_docs, sizes):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(500 + i, prose(150, i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in score_texts(docs, **sizes).collect()), key=repr)
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6
        assert abs(g[6] - w[6]) <= 0.01 * g[2] + 1e-6


def test_words_that_a_weak_hash_would_confuse(spark):
    a, b = thue_morse()
    rows = [(i, a if i % 2 else f"{b} {a}") for i in range(9)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for g, w in zip(sorted(tuple(r) for r in got), sorted(brute(rows)), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6


def test_held_out_copies_score_higher(spark):
    rows = [(i, prose(80, i % 40, 3000)) for i in range(200)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.score > r.base_score for r in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) for i, r in got.items())


def test_hot_pair_is_sent_once_a_block(spark, monkeypatch):
    from thermogrid.llm import language_model as L

    make = L._score_pairs

    def limited(*args):
        score, unpack = make(*args), L.unpack_numbers

        def check(table):
            if (n := sum(len(unpack(x, 5)) for x in table.column("words").to_pylist())) > 40:
                raise ValueError(f"{n} pairs in one shard")
            return score(table)

        return check

    monkeypatch.setattr(L, "_score_pairs", limited)
    rows = [(i, "hot pair " * (50 + i % 3) + f"own{i % 2}") for i in range(80)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    for g, w in zip(sorted(tuple(r) for r in got), sorted(brute(rows)), strict=True):
        assert g[:5] == w[:5] and abs(g[6] - w[6]) <= 0.01 * g[2]


def test_reruns_agree(spark, odd_docs):
    runs = [sorted((tuple(r) for r in score_texts(d).collect()), key=repr) for d in (odd_docs, odd_docs.repartition(6))]
    assert [r[:5] for r in runs[0]] == [r[:5] for r in runs[1]]
    assert all(abs(a[6] - b[6]) < 1e-6 for a, b in zip(*runs))


def test_empty_and_all_held_out(spark, no_docs):
    assert score_texts(no_docs).count() == 0
    held = [i for i in range(100) if in_held_out(i)][:3]
    got = score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
