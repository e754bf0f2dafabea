from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from samples import prose

from thermogrid.llm.mixing import cube_mix, flight

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, share, most, weights=(5, 2, 1)):
    """Reshares the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = share * sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        above = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def test_targets_sizes_and_limits(odd_docs):
    rows = odd_docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = water(sizes, 1.5, 2.0)
    got = cube_mix(odd_docs).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r.text or "")) for r in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]


def test_taken_words_come_near_the_target_and_reruns_agree(spark):
    rows = [(i, prose(10 + i * 7 % 90, i), f"s{min(i % 7, 4)}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cube_mix(docs.repartition(5)).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 200
        share = mine[0].target / mine[0].source_size
        assert abs(sum(r.copies for r in mine) - share * len(mine)) <= 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, cube_mix(docs.repartition(3)).collect()))


def test_flight_keeps_both_totals():
    draw = np.random.default_rng(3)
    p, x = draw.random(300), draw.integers(1, 500, 300).astype(float)
    x[:40] = 7
    q = flight(p, x, draw, land=False)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-3
    assert set(flight(p, x, draw, land=True)) <= {0.0, 1.0}


def test_flight_is_fair():
    draw = np.random.default_rng(4)
    mean = np.mean([flight(np.array([0.3, 0.5, 0.7, 0.2]), np.array([5.0, 9.0, 2.0, 4.0]), draw, land=True) for _ in range(6000)], axis=0)
    assert np.abs(mean - [0.3, 0.5, 0.7, 0.2]).max() < 0.03


def test_edges(no_docs):
    assert cube_mix(no_docs).count() == 0
    with pytest.raises(ValueError):
        cube_mix(no_docs, share=3.0)
