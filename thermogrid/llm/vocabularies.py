"""Public tokenizers applied to many short units, each distinct one once."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units kept from block to block in one worker; past that the memory starts afresh. It never changes a result.
KEPT_UNITS = 1 << 19
#: Bytes from which a unit is known by a cryptographic digest: polynomials modulo 2^64 agree on some pairs of long words whatever their base.
LONG_UNIT = 256


class UnitCache:
    """Token ids of units, looked up by a 64-bit hash; only units not met before go through the tokenizer.

    `encode` takes units as bytes and returns all their ids in one array, and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: type = np.uint16):
        self.encode, self.dtype = encode, dtype
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _add(self, keys: np.ndarray, units: list[bytes]) -> None:
        """Takes new keys in ascending order."""
        ids, sizes = self.encode(units)
        need = self.used + len(ids)
        while need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : need] = ids
        at = np.searchsorted(self.keys, keys)
        self.slot = np.insert(self.slot, at, np.arange(len(self.size), len(self.size) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.used = need

    def lookup(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit, where its ids begin in `pool`, and how many they are."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        long = np.flatnonzero(ends - starts >= LONG_UNIT)
        if len(long):
            hashes = hashes.copy()
            for i in long.tolist():
                hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        one, keys = order[new], ranked[new]  # a place of each distinct unit
        if len(self.keys) + len(keys) > KEPT_UNITS:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        lacking = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(lacking):
            place = one[lacking]
            self._add(keys[lacking], [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())])
        slots = np.empty(len(hashes), np.int32)
        slots[order] = self.slot[np.searchsorted(self.keys, keys)][np.cumsum(new) - 1]
        return self.start[slots], self.size[slots].astype(np.int64)

    def gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of all units, one after the other."""
        total = int(size.sum())
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.pool[np.arange(total) + shift]


_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_MARK = np.array([0x20 < b < 0x7F and not chr(b).isalnum() and b != 0x27 for b in range(256)])


def independent_units(data: np.ndarray, offsets: np.ndarray, fixed: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces of each document that a byte-level BPE with the usual pattern splits alike on their own.

    `fixed` are spans of whole tokens, which the library takes out before it splits anything; each is a piece.

    A piece begins before a single space, and before and after a single line end, that has a plain character on either side, and between an
    ASCII letter or digit and an ASCII mark other than the apostrophe. Plain are printable ASCII and non-ASCII characters
    that cannot be white space; elsewhere a piece simply goes on.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        plain = (data > 0x20) & (data != 0x7F)
        before = plain.copy()  # the character that ends here is plain
        before[1:] &= ~((data[:-1] == 0xC2) & (data[1:] >= 0x80))
        before[2:] &= ~((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
        after = plain & (data != 0xC2) & ~((data >= 0xE1) & (data <= 0xE3))
        single = np.zeros(n, bool)
        single[1:-1] = before[:-2] & after[2:]
        edge = np.zeros(n + 1, bool)  # a document's first or last byte has no neighbour
        edge[offsets] = True
        single &= ~(edge[:-1] | edge[1:])
        space, line = single & (data == 0x20), single & (data == 0x0A)
        cut[:-1] |= space | line
        cut[1:] |= line
        letter, mark = _ALNUM[data], _MARK[data]
        cut[1:-1] |= letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    for start, end in fixed:
        cut[start:end] = False
        cut[[start, end]] = True
    cut[offsets] = True
    marks = np.flatnonzero(cut)
    return marks[:-1], marks[1:]


class BytePairs(UnitCache):
    """A tokenizer of the tokenizers library, as its file has it."""

    #: Whether the file splits texts by the usual pattern and nothing else, so that independent_units holds for it.
    usual = False
    #: Strings that are tokens wherever they stand.
    added: re.Pattern | None = None

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.usual:
            some = np.diff(offsets) > 0
            return offsets[:-1][some], offsets[1:][some]
        raw, fixed = data.tobytes(), []
        if self.added is not None and self.added.search(raw):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                fixed += [(a + m.start(), a + m.end()) for m in self.added.finditer(raw[a:b])]
        return independent_units(data, offsets, fixed)


def _byte_alphabet() -> str:
    """The character that a byte-level vocabulary writes for each byte: itself where it prints, else the next free one from 256."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return "".join(chr(b if b in printing else next(free)) for b in range(256))


#: Units that the usual pattern leaves in one: letters (ASCII and Latin-1), digits or marks, after a space or not.
_WHOLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")


@functools.lru_cache(maxsize=1)
def byte_bpe(file: str) -> BytePairs:
    """The cache of a worker for a tokenizer file; ids are those of the tokenizer as loaded, without special tokens put around a text."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(file)
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    split, extra = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    names = sorted((t["content"].encode() for t in extra), key=len, reverse=True)
    usual = (
        split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        and spec["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in extra)
    )
    dtype = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.int32
    # The same model without the pattern, for units that the pattern leaves whole, many in a row.
    rows = Tokenizer(tokenizer.model)
    letters = _byte_alphabet()
    rows.pre_tokenizer = pre_tokenizers.Split(letters[10], "isolated")
    line_end = tokenizer.token_to_id(letters[10])

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = [usual and _WHOLE.fullmatch(u) is not None and u not in names for u in units]
        easy, hard = [i for i, w in enumerate(whole) if w], [i for i, w in enumerate(whole) if not w]
        sizes, found, owners = np.zeros(len(units), np.int64), [], []
        texts = [b"\n".join([units[i] for i in easy[k : k + 500]]).decode("latin-1").translate(letters) for k in range(0, len(easy), 500)]
        for k, e in enumerate(rows.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype)
            between = ids == line_end
            found.append(ids[~between])
            owners.append(np.array(easy[500 * k : 500 * k + 500])[np.cumsum(between)[~between]])
        for i, e in zip(hard, tokenizer.encode_batch_fast([units[i].decode() for i in hard], add_special_tokens=False)):
            found.append(np.array(e.ids, dtype))
            owners.append(np.full(len(found[-1]), i))
        if not found:
            return np.zeros(0, dtype), sizes
        owner = np.concatenate(owners)
        return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(units))

    cache = BytePairs(encode, dtype)
    cache.usual, cache.added = usual, re.compile(b"|".join(map(re.escape, names))) if names else None
    return cache


@functools.lru_cache(maxsize=1)
def pieces(file: str) -> tuple[UnitCache, np.ndarray]:
    """The cache of a worker for a sentencepiece model, and which of its ids stand for single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = model.encode([u.decode() for u in units], num_threads=1)
        return np.fromiter(itertools.chain.from_iterable(found), np.uint16), np.array([len(x) for x in found], np.int64)

    return UnitCache(encode), is_byte
