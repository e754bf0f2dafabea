from __future__ import annotations

import re

import numpy as np
import pytest
from samples import prose, thue_morse

from thermogrid.llm.components import components
from thermogrid.llm.jaccard_join import keep_one_of_each, least_difference, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    ws = WORD.findall((t or "").translate(LOW))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if (least.get(r), d) != (None, None) else None
    return sorted(((d, len(s), d if not s else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def sample_rows():
    draw = np.random.default_rng(8)
    rows, base = [], [prose(40 + 11 * k, k).split() for k in range(12)]
    for i in range(160):
        words = list(base[i % 12])
        for _ in range(int(draw.integers(0, 9))):
            at = int(draw.integers(0, len(words)))
            words[at : at + int(draw.integers(0, 3))] = [f"new{i}x{at}"] * int(draw.integers(0, 3))
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, prose(30, 77) + " " + prose(60 - 3 * i, 500 + i)) for i in range(14)]
    # A chain: neighbours link, ends do not.
    chain = prose(140, 3, 5000).split()
    rows += [(3000 + i, " ".join(chain[6 * i : 6 * i + 80])) for i in range(10)]
    return rows


@pytest.mark.parametrize("shard", [2_000_000, 300])
def test_against_brute_force(spark, odd_docs, shard):
    rows = sample_rows() + [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(docs, shard_shingles=shard).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_words_that_a_weak_hash_would_confuse(spark):
    a, b = thue_morse()
    rows = [(i, f"{w} {prose(3, 1)}") for i, w in enumerate((a, b, a))] + [(9, f"{prose(60, 4)} {a}"), (8, f"{prose(60, 4)} {b}")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_keep_one(spark, odd_docs):
    rows = odd_docs.collect()
    want = {d for d, _, c in brute([(r.doc_id, r.text) for r in rows]) if d == c}
    got = keep_one_of_each(odd_docs)
    assert got.columns == odd_docs.columns
    kept = got.collect()
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)
    assert all(r in rows for r in kept)


def test_keep_one_where_ids_are_shared(spark):
    near = prose(80, 61)
    rows = [(5, prose(60, 70 + k)) for k in range(20)]  # one id, texts that are linked with nothing
    rows += [(5, near), (3, near + " end"), (9, near), (5, prose(70, 62)), (8, prose(70, 62) + " more")]
    rows += [(None, prose(60, 63)), (None, prose(60, 64)), (None, prose(60, 64)), (None, prose(60, 64) + " tail"), (None, prose(60, 65)), (7, prose(60, 65))]
    rows += [(5, rows[0][1]), (1, ""), (1, " \n"), (1, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    kept = [{(r.doc_id, r.text): r.row for r in keep_one_of_each(d).collect()} for d in (docs, docs.repartition(5))]
    assert kept[0] == kept[1] and len(keep_one_of_each(docs).collect()) == len(kept[0])
    sure = {*rows[:20], (3, near + " end"), (5, prose(70, 62)), (None, prose(60, 63)), (7, prose(60, 65)), (1, ""), (1, " \n"), (1, None)}
    rest = set(kept[0]) - sure
    assert sure <= set(kept[0]) and len(rest) == 1 and rest <= {(None, prose(60, 64)), (None, prose(60, 64) + " tail")}


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 400).selectExpr("(id * 37) % 401 AS a", "((id + 1) * 37) % 401 AS b")
    assert {r.component for r in components(edges).collect()} == {0}


def test_bound_never_exceeds_the_difference():
    draw = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(draw.integers(0, 60, draw.integers(0, 40))) for _ in range(2))
        for depth in range(5):
            assert least_difference(x, y, depth) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert keep_one_of_each(no_docs).count() == 0
