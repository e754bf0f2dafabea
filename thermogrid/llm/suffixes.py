"""Suffix arrays by induced sorting, and permuted common prefixes, over one shard's text."""

from __future__ import annotations

import numpy as np

from thermogrid.llm import textarrays as T


def _place(sa: np.ndarray, s: np.ndarray, at: np.ndarray, edge: np.ndarray, down: bool) -> None:
    """Puts suffixes, in their order, at the moving edges of their buckets."""
    chars = s[at]
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    count = np.diff(np.append(first, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(first, count)
    heads = chars[first]
    if down:
        sa[edge[chars] - 1 - rank] = at[order]
        edge[heads] -= count
    else:
        sa[edge[chars] + rank] = at[order]
        edge[heads] += count


def _induce(s: np.ndarray, size: int, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones in the given order: larger ones left to right, then smaller ones right to left.

    A bucket is read in batches; a batch may add to the bucket that is being read, which makes the next batch.
    """
    sa = np.full(len(s), -1, np.int32)
    ends = np.cumsum(np.bincount(s, minlength=size))
    starts = np.concatenate([[0], ends[:-1]])
    present = np.flatnonzero(ends > starts).tolist()
    tail = ends.copy()
    _place(sa, s, lms[::-1], tail, True)
    head = starts.copy()
    for c in present:
        at = int(starts[c])
        while at < head[c]:
            batch = sa[at : head[c]]
            at = int(head[c])
            batch = batch[batch > 0] - 1
            batch = batch[~is_s[batch]]
            if len(batch):
                _place(sa, s, batch, head, False)
        batch = sa[tail[c] : ends[c]]
        batch = batch[batch > 0] - 1
        batch = batch[~is_s[batch]]
        if len(batch):
            _place(sa, s, batch, head, False)
    tail = ends.copy()
    for c in reversed(present):
        at = int(ends[c])
        while at > tail[c]:
            batch = sa[tail[c] : at][::-1]
            at = int(tail[c])
            batch = batch[batch > 0] - 1
            batch = batch[is_s[batch]]
            if len(batch):
                _place(sa, s, batch, tail, True)
        batch = sa[starts[c] : head[c]][::-1]
        batch = batch[batch > 0] - 1
        batch = batch[is_s[batch]]
        if len(batch):
            _place(sa, s, batch, tail, True)
    return sa


def _sort_names(name: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in ascending order; its last name is the least and stands nowhere else.

    Names are sorted again and again by pairs: a group of suffixes that agree in h names is split by the groups of the suffixes h
    places on, which makes 2h. Only groups of several go into the next round.
    """
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(head, len(name)))
    rank = np.empty(len(name), np.int64)
    rank[order] = np.repeat(head, size)
    open_, h = order[np.repeat(size > 1, size)], 1
    while len(open_):
        key = rank[open_] << 32 | rank[open_ + h]
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        group = key >> 32
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(key)) - np.repeat(edge, np.diff(np.append(edge, len(key)))) + group
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(key)))
        rank[open_] = np.repeat(place[head], size)
        open_, h = open_[np.repeat(size > 1, size)], 2 * h
    sa = np.empty(len(name), np.int64)
    sa[rank] = np.arange(len(name))
    return sa


def _classes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the leftmost of each run of those. The last character is the least."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    # Equal neighbours share the class of the next change.
    change = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(change[::-1])[::-1]
    is_s = np.ones(n, bool)
    is_s[:-1] = np.append(step, 1)[nearest] > 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    return is_s, lms


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a text of non-negative integers, in ascending order.

    Leftmost-smaller substrings are sorted by a first induction and named; names that repeat are sorted by pairs of names; a second
    induction puts all suffixes in order. An alphabet of more than 1024 characters counts as names from the start.
    """
    s = np.append(text.astype(np.int32) + 1, np.int32(0))
    size = int(s.max()) + 1
    if size > 1024 or len(s) < 3:
        return _sort_names(s)[1:].astype(np.int32)
    is_s, lms = _classes(s)
    if len(lms) > 1:
        rough = _induce(s, size, is_s, lms)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        ranked = rough[is_lms[rough]].astype(np.int64)
        # A substring goes up to the start of the next one; the last of all is the end alone.
        until = np.zeros(len(s), np.int64)
        until[lms] = np.append(lms[1:], len(s) - 1)
        sums = T.running_hash(T.mix(s.astype(np.uint64) + np.uint64(7)))
        span = until[ranked] - ranked
        mark = T.span_hash(sums, ranked, until[ranked] + 1)
        name = np.cumsum(np.concatenate([[0], (mark[1:] != mark[:-1]) | (span[1:] != span[:-1])]))
        place = np.zeros(len(s), np.int64)
        place[ranked] = name
        lms = ranked if name[-1] + 1 == len(lms) else lms[_sort_names(place[lms])]
    return _induce(s, size, is_s, lms.astype(np.int32))[1:]


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the start of the suffix just before it in order (-1: none), and the length of their common prefix.

    The length at a start is at least that at the start before it, less one; it is just that wherever both suffixes are preceded by
    the same character. Only the other places are compared, eight characters at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    some = before >= 0
    fresh = ~some | (at == 0) | (before == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = text[rest - 1] != text[before[rest] - 1]
    todo = np.flatnonzero(fresh & some)
    a, b = todo.copy(), before[todo]
    live = np.arange(len(todo))
    if text.max(initial=0) < 255:
        padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(16, np.uint64)])
        eight = np.zeros(n + 8, np.uint64)
        for k in range(8):
            eight |= padded[k : n + 8 + k] << np.uint64(8 * k)
        while len(live):
            live = live[(a[live] < n) & (b[live] < n)]
            live = live[eight[a[live]] == eight[b[live]]]
            a[live] += 8
            b[live] += 8
        live = np.arange(len(todo))
    while len(live):
        live = live[(a[live] < n) & (b[live] < n)]
        live = live[text[a[live]] == text[b[live]]]
        a[live] += 1
        b[live] += 1
    length = np.zeros(n, np.int64)
    length[todo] = a - todo
    last = np.maximum.accumulate(np.where(fresh, at, -1))
    held = np.where(last >= 0, length[np.maximum(last, 0)] - (at - last), 0)
    return before, np.maximum(held, 0)
