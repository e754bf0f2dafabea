"""Periodic runs of words: a suffix automaton grows word by word, and a link-cut tree over its links tells where each suffix last ended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermogrid.llm.textarrays import give_back

#: Bytes of text looked at together; it never changes a result.
BLOCK = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs_of(ids: list[int], power: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least `power` periods and `least` words, in order of their ends.

    The suffixes of the words so far lie on the path from the automaton's last state to its root, longer ones deeper. Each
    state has the place where its strings last ended; along the path these places fall into few segments, which are
    the preferred paths of the link-cut tree. To append word i is to access the new state: every segment that the access
    meets has one previous end j, and its deepest state the length L of the longest suffix that ended there. With
    d = i - j, two equal neighbours of d words end at i if d <= L, and the whole stretch with period d is the last L + d
    words: L is exact, so it cannot grow to the left, and it is a run if the next word does not go on with it. The
    segment with the least d for a stretch is met first in length, so d is its smallest period. The access then gives the
    path the place i. That is O(n log n) in all.
    """
    sym, dst, more = [-1], [-1], {}  # a state's first transition, and the others where it has some
    size, link = [0], [-1]
    left, right, up, place = [-1], [-1], [-1], [-1]  # splay trees of the preferred paths; `place` holds at their roots
    n, last, out = len(ids), 0, []

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if p < 0:
                return
            if left[p] == x:
                p_left = True
            elif right[p] == x:
                p_left = False
            else:
                return
            g = up[p]
            if g >= 0 and left[g] == p:
                g_side = 1
            elif g >= 0 and right[g] == p:
                g_side = 2
            else:
                g_side = 0
            if not g_side:  # p is the root
                place[x] = place[p]
                if p_left:
                    c = right[x]
                    left[p], right[x] = c, p
                else:
                    c = left[x]
                    right[p], left[x] = c, p
                if c >= 0:
                    up[c] = p
                up[p], up[x] = x, g
                return
            top = up[g]
            if top >= 0 and left[top] == g:
                left[top] = x
            elif top >= 0 and right[top] == g:
                right[top] = x
            else:
                place[x] = place[g]
            if p_left == (g_side == 1):  # both on one side: the upper pair turns first
                if p_left:
                    b, c = right[p], right[x]
                    left[g], right[p], left[p], right[x] = b, g, c, p
                else:
                    b, c = left[p], left[x]
                    right[g], left[p], right[p], left[x] = b, g, c, p
                if b >= 0:
                    up[b] = g
                if c >= 0:
                    up[c] = p
                up[g], up[p] = p, x
            else:
                b, c = left[x], right[x]
                if p_left:
                    right[g], left[p], left[x], right[x] = b, c, g, p
                    if b >= 0:
                        up[b] = g
                    if c >= 0:
                        up[c] = p
                else:
                    right[p], left[g], left[x], right[x] = b, c, p, g
                    if b >= 0:
                        up[b] = p
                    if c >= 0:
                        up[c] = g
                up[g] = up[p] = x
            up[x] = top

    for i in range(n):
        w = ids[i]
        new = len(size)
        sym.append(-1)
        dst.append(-1)
        size.append(i + 1)
        left.append(-1)
        right.append(-1)
        place.append(-1)
        p, q = last, -1
        while p >= 0:
            a = sym[p]
            if a == w:
                q = dst[p]
                break
            if a < 0:
                sym[p], dst[p] = w, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {w: new}
                elif w in others:
                    q = others[w]
                    break
                else:
                    others[w] = new
            p = link[p]
        if q < 0:
            q = 0
        elif size[p] + 1 != size[q]:  # the strings of q up to p's and w ended here too: they become a state between q and its link
            fresh = new + 1
            sym.append(sym[q])
            dst.append(dst[q])
            if q in more:
                more[fresh] = dict(more[q])
            size.append(size[p] + 1)
            link.append(q)  # of `new`; set below
            link.append(link[q])
            link[q] = fresh
            while p >= 0:
                if sym[p] == w:
                    if dst[p] != q:
                        break
                    dst[p] = fresh
                else:
                    others = more[p]
                    if others[w] != q:
                        break
                    others[w] = fresh
                p = link[p]
            splay(q)
            above = left[q]
            left.append(above)
            right.append(-1)
            place.append(-1)
            if above >= 0:
                up[above] = fresh
            left[q] = fresh
            up.append(fresh)  # of `new`
            up.append(q)
            link[new] = fresh
            q = fresh
        if len(link) == new:
            link.append(q)
            up.append(q)
        last, below, x = new, new, q
        following = ids[i + 1] if i + 1 < n else -1
        while x >= 0:
            splay(x)
            j, length = place[x], size[x]
            d = i - j
            if length >= (power - 1) * d and length + d >= least and (following < 0 or following != ids[i + 1 - d]) and length:
                out.append((j - length + 1, length + d, d))
            cut = right[x]
            if cut >= 0:
                place[cut] = j
            right[x] = below
            below, x = x, up[x]
        place[below] = i
    return out


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's rank among the distinct ones, and how often its key is there."""
    _, rank, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return rank, counts[rank]


def stretches(ids: np.ndarray, owner: np.ndarray, power: int, least: int) -> list[tuple[int, int]]:
    """First and end of the stretches, each within one text, outside which no run can lie.

    In a run every word stands at least `power` times and every three words in a row at least power - 1 times (fewer only
    where `least` is small). Words and triples that do not stand that often in their stretch part it, until nothing changes.
    """
    n = len(ids)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if n > 2 else np.zeros(0, np.int64)
    if not len(at):
        return []
    spread = np.int64(ids.max() + 1)
    pair, _ = _ranks(ids[at] * spread + ids[at + 1])
    triple, _ = _ranks(pair * spread + ids[at + 2])
    span = np.int64(triple.max() + 1)
    thrice = max(1, min(power - 1, max(least, power) - 2))
    while len(at):
        parted = np.concatenate([[True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])])
        part = np.cumsum(parted) - 1
        keep = _ranks(part * span + triple)[1] >= thrice
        first = np.flatnonzero(parted)
        count = np.diff(np.append(first, len(at)))
        keep &= (count >= least - 2)[part]
        if keep.all():  # triples are frequent enough; now the words, two more than the triples in each stretch
            place = np.arange(len(at) + 2 * len(first)) - np.repeat(2 * np.arange(len(first)) - at[first] + first, count + 2)
            # Place k of a stretch is its first word's place plus k.
            often = _ranks(np.repeat(np.arange(len(first)), count + 2) * spread + ids[place])[1] >= power
            mine = np.arange(len(at)) + 2 * part
            keep = often[mine] & often[mine + 1] & often[mine + 2]
            if keep.all():
                return [(int(at[f]), int(at[f] + c + 2)) for f, c in zip(first, count)]
        at, triple = at[keep], triple[keep]
    return []


def _runs(power: int, least: int):
    def texts(column: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
        row = 0
        while row < len(column):
            first, held, n = row, [], 0
            while row < len(column) and n < BLOCK:
                raw = (column[row] or "").encode()
                if held and n + len(raw) > BLOCK:
                    break
                held.append(raw.split())  # exactly the ASCII white space characters part words
                n += len(raw)
                row += 1
            yield first, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in texts(b.column(1).to_pylist()):
                number: dict[bytes, int] = {}
                sizes = [len(words) for words in held]
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                ids = np.fromiter((number.setdefault(w, len(number)) for words in held for w in words), np.int64, int(bounds[-1]))
                owner = np.repeat(np.arange(len(held)), sizes)
                found: list[list[dict]] = [[] for _ in held]
                for a, e in stretches(ids, owner, power, least):
                    doc = int(owner[a])
                    shift = a - int(bounds[doc])
                    found[doc] += [{"start": s + shift, "length": n, "period": p} for s, n, p in runs_of(ids[a:e].tolist(), power, least)]
                collapsed = []
                for words, runs in zip(held, found):
                    runs.sort(key=lambda r: (r["start"], r["period"]))
                    if runs:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for r in runs:
                            gone[r["start"] + r["period"]] += 1
                            gone[r["start"] + r["length"]] -= 1
                        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(held)), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(collapsed, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
            give_back()

    return run


def find_runs(docs: DataFrame, power: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, `runs` (start, length, period in words, by start and period) and `collapsed`.

    A run is a maximal stretch of white space words with smallest period q and at least max(`least`, `power` * q) words. In
    `collapsed` every run keeps its first q words; the words that stay are joined by single spaces.

    Only stretches whose words and triples of words stand often enough for a run go through the automaton; the others
    cannot hold one. Documents are worked on one by one where they lie, without a shuffle, so groups of copies and common words
    meet nowhere. A null or empty text has no words and no runs; repeated rows are rows of their own; other columns are left out,
    whatever their names; an empty table gives no rows. A text is held whole: some 150 bytes a word, and about 600 more a
    word of its longest stretch, must fit a worker.
    """
    if power < 2 or least < 3:
        raise ValueError("a run has at least two periods and three words")
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return light.mapInArrow(_runs(power, least), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
