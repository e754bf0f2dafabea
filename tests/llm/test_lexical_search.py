"""Ranks and scores against a plain scoring of all pairs."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from samples import ODD, prose

from thermogrid.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    """docs: rows of (id, text). Items with one id and text are one."""
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, length in held:
            m = 100 - 75 + (75 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


DOCS = [(i, prose(20 + 11 * (i % 9), i % 25, 120)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, prose(30, 3)), (7, "seven"), (7, "seven"), (None, "seven"), (300, "Seven, é İ ＡB a-b_c")]
ITEMS = [(i, prose(4 + i % 9, i, 120)) for i in range(40)] + [(40, None), (41, ""), (42, "..."), (43, "seven"), (43, "seven"), (43, "SEVEN times seven seven"), (None, "é a b c"), (44, "nowhere at all")]


@pytest.mark.parametrize("width,block_bytes", [(1024, 1 << 20), (8, 3000), (1, 1 << 20)])
def test_against_brute_force(spark, width, block_bytes, monkeypatch):
    monkeypatch.setattr(L, "BOUNDS", 600)  # several batches a task
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, item string, score int").repartition(3)
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, term int").repartition(2)
    assert rows(L.search(docs, items, 10, width=width, block_bytes=block_bytes)) == brute(DOCS, ITEMS, 10)


def block_and_batch(docs, items, width):
    held = [c for c in (Counter(cut(t)) for _, t in docs) if c]
    df = Counter(t for c in held for t in c)

    class Row:
        def __init__(self, item, term, times):
            self.item, self.tie, self.term, self.times, self.docs = item, "", term.encode(), times, df[term]

    block = L.ItemBlock([Row(i, t, n) for i, text in items for t, n in Counter(cut(text)).items() if t in df], len(held), sum(map(lambda c: sum(c.values()), held)), width)
    coded = [np.array([block.slot[t.encode()] for t in cut(text) if t.encode() in block.slot], np.int64) for _, text in docs]
    return block, L.Batch(block, coded, [len(cut(t)) for _, t in docs])


@pytest.mark.parametrize("width", [2, 64, 1024])
def test_bounds_hold_and_spare_work(width):
    docs, items = [(i, prose(60, i, 600)) for i in range(300)], [(i, prose(8, 1000 + i, 600)) for i in range(20)]
    block, batch = block_and_batch(docs, items, width)
    upper = batch.upper()
    doc, item = np.indices(upper.shape)
    exact = batch.exact(doc.ravel(), item.ravel()).reshape(upper.shape)
    assert (upper >= exact).all() and exact.any()
    best = L.Best(len(items), 10)
    scored = batch.search(best, np.arange(300), np.zeros(300, bool))
    assert scored <= exact.size and (width < 1024 or scored < exact.size // 4)


def test_odd_and_empty(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows(L.search(odd_docs, items))
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS, 10)
    assert rows(L.search(no_docs, items)) == [] == rows(L.search(odd_docs, items.limit(0)))


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(L, "SLICE", 1000)
    texts = [(1, prose(60_000, 1)), (2, "x" * 2_000_000 + " end"), (3, prose(50, 2))]
    items = [(1, prose(6, 1) + " end")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(L.search(docs, spark.createDataFrame(items, "item_id long, text string"))) == brute(texts, items, 10)
