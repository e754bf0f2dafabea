"""Words, hashes and byte blocks of many texts at once, as numpy arrays over the Arrow buffers.

Word classes here are decided by bytes: all bytes of a non-ASCII character are at least 0x80 and belong to words, so
byte and code point rules agree. Hashes are polynomials modulo two primes over random byte values, mixed at the end: modulo a power of two some
texts that can be written down (Thue-Morse words) would meet whatever the values.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _lower(values: np.ndarray) -> np.ndarray:
    values[65:91] = values[97:123]
    return values


#: The two largest primes below 2^32, so that residues multiply within 64 bits, and a base for each.
PRIMES = (np.uint64(4294967291), np.uint64(4294967279))
_BASES = (2654435769, 3266489917)


@functools.cache
def _byte_values(lower: bool) -> np.ndarray:
    """256 values of 12 bits for each prime."""
    rng = np.random.default_rng(20240229)
    values = [rng.permutation(np.arange(1, 4096, dtype=np.uint16))[:256] for _ in PRIMES]
    return np.stack([_lower(v) for v in values]) if lower else np.stack(values)


@functools.cache
def _word_bytes(spaces_only: bool) -> np.ndarray:
    """True for the bytes of words: all but white space, or only digits, letters and non-ASCII."""
    table = np.ones(256, bool)
    if spaces_only:
        table[list(SPACES)] = False
    else:
        table[:128] = [chr(c).isalnum() for c in range(128)]
    return table


def _rest(x: np.ndarray, p: np.uint64) -> np.ndarray:
    """x modulo p; dividing by one number is what numpy does fast."""
    q = x // p
    q *= p
    return np.subtract(x, q, out=q)


_KEPT_POWERS = 1 << 22
_POWERS: list[list[np.ndarray]] = [[np.ones(1, np.uint32)] * 2] * 2


def powers(n: int) -> list[list[np.ndarray]]:
    """For each prime: base^i and its inverse, for i up to n. Those of longer texts are not kept."""
    global _POWERS
    if len(_POWERS[0][0]) > n:
        return _POWERS
    size = -(-(n + 1) // (1 << 18)) << 18
    made = []
    for p, base in zip(PRIMES, _BASES):
        pair = []
        for b in (base, pow(base, -1, int(p))):
            grown, have = np.ones(size, np.uint32), 1
            while have < size:
                more = min(have, size - have)
                grown[have : have + more] = _rest(grown[:more] * np.uint64(pow(b, have, int(p))), p)
                have += more
            pair.append(grown)
        made.append(pair)
    if size <= _KEPT_POWERS:
        _POWERS = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CHUNK = 1 << 15  # elements at a time: they stay in the processor's cache, and sums of 12 times 32 bits within 64


def _sums(terms: Callable[[int, slice, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Running sums modulo each prime of terms(prime's number, places, powers there)."""
    out = np.zeros((2, n + 1), np.uint32)
    for k, ((ups, _), p) in enumerate(zip(powers(n), PRIMES)):
        for i in range(0, n, _CHUNK):
            here = slice(i, min(i + _CHUNK, n))
            run = np.cumsum(terms(k, here, ups[here]))
            run += np.uint64(out[k, i])
            out[k, here.start + 1 : here.stop + 1] = _rest(run, p)
    return out


def prefix_hash(data: np.ndarray, lower: bool) -> np.ndarray:
    """n + 1 running sums for each prime, from which span_hash takes the hash of any span of bytes."""
    values = _byte_values(lower)
    return _sums(lambda k, here, ups: np.multiply(values[k].take(data[here]), ups, dtype=np.uint64), len(data))


def running_hash(values: np.ndarray) -> np.ndarray:
    """The same over 64-bit values in place of bytes."""
    return _sums(lambda k, here, ups: _rest(_rest(values[here], PRIMES[k]) * ups, PRIMES[k]), len(values))


def _span_hash(ends: Iterable[np.ndarray], starts: Iterable[np.ndarray], downs: Iterable[np.ndarray]) -> np.ndarray:
    first, second = (_rest(_rest(e + p - s, p) * down, p) for e, s, down, p in zip(ends, starts, downs, PRIMES))
    return mix((first << np.uint64(32)) | second)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    downs = powers(sums.shape[1])
    return _span_hash((s[end] for s in sums), (s[start] for s in sums), (d[start] for _, d in downs))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hash of all spans of one width."""
    n = sums.shape[1] - width
    return _span_hash((s[width:] for s in sums), (s[:n] for s in sums), (d[:n] for _, d in powers(sums.shape[1])))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live long, and an executor's memory is one budget."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets) of runs of rows; a run passes the limit only if it is one long text.

    A null text has no bytes.
    """
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    give_back()


def words(data: np.ndarray, offsets: np.ndarray, spaces_only: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in a block, and where each document's words begin among them (n + 1 numbers)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _word_bytes(spaces_only)[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def combine(hashes: Iterable[np.ndarray]) -> np.ndarray:
    """One hash of several hashes in order, element by element."""
    out = None
    for h in hashes:
        out = h.copy() if out is None else mix(out * _ODD + h)
    return out
