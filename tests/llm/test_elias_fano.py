from __future__ import annotations

import bisect

import numpy as np
import pytest

from thermogrid.llm.elias_fano import BigramTrie, EliasFano


@pytest.mark.parametrize("n,universe", [(1, 1), (1, 10**12), (5, 5), (1000, 1000), (1000, 10**9), (3000, 10**4), (700, 1 << 40), (0, 10)])
def test_access_and_successor(n, universe):
    draw = np.random.default_rng(n + universe % 97)
    values = np.sort(draw.integers(0, universe, n).astype(np.uint64))
    e = EliasFano.build(values, universe)
    assert e.get(np.arange(n)).tolist() == values.tolist()
    ask = np.concatenate([draw.integers(0, universe, 2000).astype(np.uint64), values, np.array([0, universe - 1], np.uint64)])
    at, value = e.successor(ask)
    as_list = values.tolist()
    for x, i, v in zip(ask.tolist(), at.tolist(), value.tolist()):
        want = bisect.bisect_left(as_list, x)
        assert i == want and (v == as_list[i] if i < n else v == 0)


def test_compact():
    values = np.sort(np.random.default_rng(3).integers(0, 1 << 36, 100_000).astype(np.uint64))
    e = EliasFano.build(values, 1 << 36)
    assert (e.low.nbytes + e.high.nbytes) * 8 / 100_000 < 36 - 16.6 + 2.5


def test_trie():
    draw = np.random.default_rng(7)
    pairs = sorted({(int(a), int(b)) for a, b in zip(draw.integers(0, 300, 5000) ** 3, draw.integers(0, 1 << 30, 5000) >> draw.integers(0, 30, 5000))})
    context, word = (np.array(x, np.uint64) for x in zip(*pairs))
    prob = draw.normal(-4, 2, len(pairs))
    trie = BigramTrie.build(context, word, prob)
    there, got = trie.query(context, word)
    assert there.all() and np.abs(got - prob).mean() < 0.05 and len(trie.book) <= 256
    known = set(pairs)
    ask = [(a, b) for a, b in zip(draw.integers(0, 300, 4000).astype(object) ** 3, draw.integers(0, 1 << 31, 4000).tolist())] + [(1, 1), (pairs[0][0], 1 << 39), (1 << 39, 0)]
    there, _ = trie.query(*(np.array(x, np.uint64) for x in zip(*ask)))
    assert there.tolist() == [p in known for p in ask]


def test_empty_trie():
    none = np.zeros(0, np.uint64)
    trie = BigramTrie.build(none, none, np.zeros(0))
    assert not trie.query(np.array([1], np.uint64), np.array([2], np.uint64))[0].any()
