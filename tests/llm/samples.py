"""Texts for the tests of corpus operators."""

from __future__ import annotations

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    import numpy as np

    draw = np.random.default_rng(seed)
    words = ["".join(LETTERS[(w * 7 + k * k * 3 + w // 26) % 26] for k in range(2 + w % 6)) for w in draw.integers(0, vocabulary, n)]
    return " ".join(w if i % 13 else w.capitalize() + "," for i, w in enumerate(words)).replace(" zz ", "\n")


ODD = [
    None, "", " ", "\n", "\n\n a\n", "A", "Ünïcode ÉÉ é x 　 y", "tab\tand\x0bfeed\r\nline", "# $ % & * | < >", "don't  he'll 's  x  ",
    "<|endoftext|> is text", " sep  \u0085next", "\U0001F600 emoji \U0001F600", "a" * 3000, "ab " * 400, "x\n" * 40, "0 1 2 3 4 5 6 7 8 9 10 11",
]


def thue_morse():
    """Two words whose polynomial hashes modulo a power of two are equal."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
