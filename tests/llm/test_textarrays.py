"""Hashes of spans: equal for equal bytes wherever they stand, different for texts built to meet."""

from __future__ import annotations

import numpy as np
import pytest

from samples import thue_morse
from thermogrid.llm import textarrays as T


def bytes_of(text):
    return np.frombuffer(text.encode(), np.uint8)


@pytest.mark.parametrize("lower", [True, False])
def test_equal_bytes_equal_hashes(lower):
    rng = np.random.default_rng(5)
    data = np.frombuffer(bytes(rng.choice(list(b"aAbB \n\xc3\xa9"), 4000).tolist()), np.uint8)
    start = rng.integers(0, 3990, 3000)
    end = start + rng.integers(0, 7, 3000)
    found = {}
    for a, e, h in zip(start, end, T.span_hash(T.prefix_hash(data, lower), start, end)):
        text = data[a:e].tobytes()
        found.setdefault(text.lower() if lower else text, set()).add(int(h))
    assert all(len(h) == 1 for h in found.values())
    assert len(set().union(*found.values())) == len(found)


def test_windows_are_spans():
    data = bytes_of("abracadabra " * 30)
    sums, at = T.prefix_hash(data, False), np.arange(len(data) - 8)
    assert (T.window_hash(sums, 9) == T.span_hash(sums, at, at + 9)).all()
    assert len(np.unique(T.window_hash(sums, 9))) == 12


def test_words_that_meet_modulo_a_power_of_two():
    a, b = thue_morse()
    sums = T.prefix_hash(bytes_of(a + b), False)
    one, two = T.span_hash(sums, np.array([0, 1024]), np.array([1024, 2048]))
    assert one != two
    values = np.frombuffer((a + b).encode(), np.uint8).astype(np.uint64)
    one, two = T.span_hash(T.running_hash(values), np.array([0, 1024]), np.array([1024, 2048]))
    assert one != two


def test_places_beyond_the_kept_powers():
    n = T._KEPT_POWERS + 1000
    data = np.resize(bytes_of("the quick brown fox "), n)
    sums = T.prefix_hash(data, False)
    far = n // 20 * 20 - 40
    one, two = T.span_hash(sums, np.array([0, far]), np.array([31, far + 31]))
    assert one == two
    assert len(T._POWERS[0][0]) <= T._KEPT_POWERS
