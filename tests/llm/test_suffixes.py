from __future__ import annotations

import numpy as np
import pytest

from thermogrid.llm.suffixes import permuted_prefixes, suffix_array


@pytest.mark.parametrize("size", [1, 2, 3, 5, 26, 250])
def test_against_sorting(size):
    draw = np.random.default_rng(size)
    for n in [0, 1, 2, 3, 4, 7, 20, 60, 300] * 3:
        text = draw.integers(0, size, n)
        if n > 50 and size > 2:
            text = np.concatenate([text, text[: n // 2], text[n // 3 :]])
        raw = bytes(text.tolist())
        sa = suffix_array(text.astype(np.uint8))
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        before, length = permuted_prefixes(text.astype(np.uint8), sa)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist()):
            k = 0
            while i + k < len(raw) and j + k < len(raw) and raw[i + k] == raw[j + k]:
                k += 1
            assert before[i] == j and length[i] == k, (raw, i, j, k)


def test_many_names():
    """A large alphabet goes through the one-at-a-time form."""
    draw = np.random.default_rng(1)
    text = draw.integers(0, 3000, 4000)
    text = np.concatenate([text, text[1000:3000], text[:100]])
    sa = suffix_array(text)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
