from __future__ import annotations

import re

import pytest
from samples import prose

from thermogrid.llm.decontamination import decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, window=10):
    grams = {}
    for name, text in items:
        ws = words(text)
        n = min(len(ws), window)
        for i in range(len(ws) - n + 1) if ws else ():
            grams.setdefault(n, {}).setdefault(tuple(ws[i : i + n]), set()).add(name)
    out = []
    for i, t in docs:
        ws, hit, names = words(t), set(), set()
        for n, found in grams.items():
            for j in range(len(ws) - n + 1):
                if (g := tuple(ws[j : j + n])) in found:
                    hit |= set(range(j, j + n))
                    names |= found[g]
        out.append((i, len(ws), len(hit), sorted(names)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark, odd_docs):
    a, b = prose(40, 101).split(), prose(25, 102).split()
    items = [(1, " ".join(a)), (2, " ".join(b)), (10, " ".join(a[5:30])), (3, "short one here"), (4, None), (5, "..."), (6, "zero"), (7, " ".join(a)), (8, "one here")]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs += [
        (100, "before it " * 15 + " ".join(a[3:20]).upper() + " after"), (101, " ".join(b)), (102, " ".join(b[:9])), (103, "a SHORT, one here! zero"),
        (104, " ".join(a[:12] + ["gap"] + b[2:13] + a[20:29])), (105, "short one short one here"), (106, " ".join(a[10:20] + a[10:20])),
    ]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_against_brute_force(spark, tables, block):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [(str(i), t) for i, t in items])
    got = find_contamination(d, b, block_bytes=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == want
    for r in got:
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"])
        assert all(x.end < y.first for x, y in zip(r.spans, r.spans[1:]))


def test_decontaminate(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, n_hit long")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {i: (n, h) for i, n, h, _ in brute(docs, [(str(i), t) for i, t in items]) if i is not None}
    got = {r.doc_id: r for r in decontaminate(d, b).collect() if r.doc_id is not None}
    assert set(want) - set(got) == {i for i, (n, h) in want.items() if h > 0.5 * n}
    texts = dict(docs)
    for i, r in got.items():
        n, h = want[i]
        assert r.n_hit == i
        assert r.text == texts[i] if not h else len(words(r.text)) == n - h
    assert got[100].text == "before it " * 15 + " after"


def test_decontaminate_by_blocks(spark, tables):
    docs, items = tables
    x, y = [f"x{k}" for k in range(1, 21)], prose(60, 103).split()
    items = [*items, (20, " ".join(x[:12])), (21, " ".join(x[3:])), *((30 + k, " ".join(y[10 * k : 10 * k + 10])) for k in range(6))]
    docs = [
        *docs, (200, " ".join([*["fine words"] * 20, *x, "end"])),
        (201, " ".join([*y[:30], *["other"] * 20])), (202, " ".join([*y[:30], *["other"] * 40])),  # hit by several blocks together
        (203, " ".join([*["clean"] * 40, *x[:5], *y[:10], *x[5:12]])),  # a cut brings benchmark words together
        (200, "the same id"), (None, None),
    ]
    d = spark.createDataFrame([(i, t, 1, i, "s") for i, t in docs], "spans int, text string, t1 int, doc_id long, row string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (decontaminate(d, b, block_bytes=n) for n in (1 << 20, 100))
    assert parts.columns == d.columns
    parts = parts.collect()
    assert sorted(map(tuple, parts), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    want = {(i, t): (n, h) for (i, t), (_, n, h, _) in ((r, brute([r], [(str(k), v) for k, v in items])[0]) for r in docs)}
    assert len(parts) == sum(h <= 0.5 * n for r in docs for n, h in [want[r]])
    left = {r.doc_id: r.text for r in parts if r.text != "the same id"}
    assert left[200] == "fine words " * 20 + " end" and 201 not in left
    assert left[202].split() == ["other"] * 40 and words(left[203]) == ["clean"] * 40 + x[:12]


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert {r.n_hit for r in find_contamination(odd_docs, none).collect()} == {0}
    assert find_contamination(no_docs, some).count() == 0
    assert decontaminate(odd_docs, none).count() == odd_docs.count()
    assert decontaminate(no_docs, some).count() == 0
