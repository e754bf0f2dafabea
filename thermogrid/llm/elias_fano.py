"""Monotone sequences in Elias-Fano form and an n-gram trie made of them, over arrays that may be memory-mapped."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np

_BYTE_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Where the k-th one of a byte stands; entry [byte, k].
_BYTE_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


@dataclass
class EliasFano:
    """n values in ascending order below a universe: low bits packed, high bits in unary.

    High part h of the i-th value is a one at bit h + i; `ones` counts the ones before each 64-bit word.
    """

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        words = ((universe >> low_bits) + n) // 64 + 2
        bits = np.zeros(words * 64, bool)
        bits[high + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(_BYTE_COUNT[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64))])[:-1]
        total = n * low_bits
        low = np.zeros(total // 64 + 2, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            spill = (at & 63) + low_bits > 64
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (np.uint64(64) - shift[spill]))
        return EliasFano(n, low_bits, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.low[word] >> shift
        over = shift > 0
        part[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return part & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Bit of the k-th one or zero of the high bits."""
        before = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if zeros else self.ones
        word = np.searchsorted(before, k, "right") - 1
        left = k - before[word]
        raw = self.high[word]
        octets = (~raw if zeros else raw).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_BYTE_COUNT[octets], axis=1, dtype=np.int64)
        octet = (upto <= left[:, None]).sum(1)
        octet = np.minimum(octet, 7)
        rows = np.arange(len(k))
        within = left - np.where(octet > 0, upto[rows, np.maximum(octet - 1, 0)], 0)
        return word * 64 + octet * 8 + _BYTE_SELECT[octets[rows, octet], np.minimum(within, 7)]

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, False) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, the first place whose value is at least x (n if there is none), and that value (0 then).

        The zeros of the high bits bound the values with the same high part; a binary search over their low bits ends it.
        """
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64)
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - (h - 1), 0)
        last = self._select(h, True) - h
        low, high = np.clip(first, 0, self.n), np.clip(last, 0, self.n)
        want = x & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less = self._low(mid) < want[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        value = self.get(np.minimum(low, self.n - 1))
        return low, np.where(low < self.n, value, np.uint64(0))


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a file without a name, memory-mapped read-only; it goes when the last of them goes."""
    with tempfile.TemporaryFile() as file:
        spots = []
        for a in arrays:
            spots.append((file.tell(), a.dtype, a.shape))
            file.write(np.ascontiguousarray(a).tobytes())
            file.write(b"\0" * (-file.tell() % 8))
        file.write(b"\0" * 8)
        file.flush()
        whole = np.memmap(file, np.uint8, "r")
    return [np.ndarray(shape, kind, whole, at) for at, kind, shape in spots]


@dataclass
class BigramTrie:
    """Contexts, pointers into the level of their successors, the successors, and a code of each one's log probability.

    Successor ids ascend only within a context. Each is stored on top of its context's base, the sum of the widths of the contexts
    before it, which makes the level one monotone sequence; a query adds the base and looks for the successor of the sum
    within the context's range.
    """

    contexts: EliasFano
    pointers: EliasFano
    bases: EliasFano
    successors: EliasFano
    codes: np.ndarray
    book: np.ndarray

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, log_prob: np.ndarray, codes: int = 256) -> BigramTrie:
        """From pairs in ascending order and their log probabilities, on at most `codes` levels: equal steps, each at the mean of its values."""
        new = np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
        first = np.flatnonzero(new)
        pointer = np.append(first, len(context)).astype(np.uint64)
        widest = np.maximum.reduceat(word, first) + np.uint64(1) if len(first) else np.zeros(0, np.uint64)
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(widest, dtype=np.uint64)])
        level = word + np.repeat(base[:-1], np.diff(pointer).astype(np.int64))
        top = int(base[-1]) + 1
        levels = np.unique(log_prob)
        if len(levels) > codes:
            step = (levels[-1] - levels[0]) / codes
            code = np.minimum(((log_prob - levels[0]) / step).astype(np.int64), codes - 1)
            book = np.bincount(code, log_prob, minlength=codes) / np.maximum(np.bincount(code, minlength=codes), 1)
        else:
            code, book = np.searchsorted(levels, log_prob), levels
        made = [
            EliasFano.build(context[first], int(context[-1]) + 1 if len(context) else 1), EliasFano.build(pointer, len(context) + 1),
            EliasFano.build(base, top), EliasFano.build(level, top),
        ]
        flat = mapped([x for e in made for x in (e.low, e.high, e.ones)] + [code.astype(np.uint8), book])
        kept = [EliasFano(e.n, e.low_bits, *flat[3 * k : 3 * k + 3]) for k, e in enumerate(made)]
        return BigramTrie(*kept, flat[-2], flat[-1])

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is there, and its log probability (0 where it isn't)."""
        if not self.contexts.n:
            return np.zeros(len(word), bool), np.zeros(len(word))
        at, value = self.contexts.successor(context)
        there = (at < self.contexts.n) & (value == context)
        at = np.where(there, at, 0)
        low, high = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        base, beyond = self.bases.get(at), self.bases.get(at + 1)
        want = base + word
        there &= want < beyond  # wider than any successor of the context
        place, value = self.successors.successor(np.where(there, want, np.uint64(0)))
        there &= (place >= low) & (place < high) & (value == want)
        return there, np.where(there, self.book[self.codes[np.where(there, place, 0)]], 0.0)
