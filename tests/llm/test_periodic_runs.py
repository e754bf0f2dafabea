"""Runs against a search over all periods and places."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from samples import ODD, prose

from thermogrid.llm import periodic_runs as P


def brute(words, power, least):
    n, found = len(words), []
    for q in range(1, n // power + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - first
            part = words[first:i]
            smaller = any(all(part[k] == part[k - p] for k in range(p, length)) for p in range(1, q))
            if length >= max(least, power * q) and not smaller:
                found.append((first, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("power,least", [(4, 6), (2, 3), (3, 7)])
def test_automaton_against_brute_force(power, least):
    draw = np.random.default_rng(power)
    for trial in range(400):
        n, letters = int(draw.integers(0, 60)), int(draw.integers(1, 4))
        ids = draw.integers(0, letters, n).tolist()
        if trial % 3 == 0 and n:
            p = int(draw.integers(1, max(2, n // 4)))
            ids = [ids[k % p] for k in range(n)]
            if trial % 2:
                ids[n // 2] = 7
        want = brute(ids, power, least)
        assert sorted(P.runs_of(ids, power, least), key=lambda r: (r[0], r[2])) == want
        cut = P.stretches(np.array(ids, np.int64), np.zeros(n, np.int64), power, least)
        assert sorted({(s + a, m, q) for a, e in cut for s, m, q in P.runs_of(ids[a:e], power, least)}, key=lambda r: (r[0], r[2])) == want


def test_long_runs():
    assert P.runs_of([5] * 20_000) == [(0, 20_000, 1)]
    period = np.random.default_rng(1).integers(0, 50, 3001).tolist()
    assert P.runs_of(period * 5 + [99]) == [(0, 15_005, 3001)]
    word = [0]
    for _ in range(12):  # the Thue-Morse word holds squares but no run of more than two periods
        word = word + [1 - x for x in word]
    assert P.runs_of(word) == []


def texts():
    out = [*ODD, "a b " * 9, "x " + "a b c " * 4 + "a b d", "a a a a a a", "a a a a a", "ab ab ab", "a\x1fb a\x1fb a\x1fb a\x1fb a\x1fb a\x1fb", "é é　x " * 6]
    for i in range(30):
        words = prose(30 + 7 * i, i, 40 if i % 2 else 6).split(" ")
        p = 1 + i % 9
        out.append(" ".join([*words[:5], *(words[k % p] for k in range(len(words))), *words[5:9]]))
    return [*out, " ".join(out[-1:] * 5), prose(400, 77, 3)]


def test_rows(spark, monkeypatch):
    rows = [(i, t, "runs", 1) for i, t in enumerate(texts())] + [(None, "no id " * 8, "x", 1), (3, "again " * 7, "x", 1), (3, "again " * 7, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").repartition(3)
    want = []
    for d, t, *_ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute(words, 4, 6)
        want.append((d, len(words), runs, collapsed(words, runs)))
    for block in (1, 1 << 20):
        monkeypatch.setattr(P, "BLOCK", block)
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.find_runs(docs).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_odd_and_empty(spark, odd_docs, no_docs):
    assert P.find_runs(odd_docs).count() == odd_docs.count() and P.find_runs(no_docs).count() == 0


def test_long_text():
    words = prose(150_000, 8, 3000).split(" ") + ["one", "two", "three"] * 10_000
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], np.int64)
    found = [(s + a, n, q) for a, e in P.stretches(ids, np.zeros(len(ids), np.int64), 4, 6) for s, n, q in P.runs_of(ids[a:e].tolist())]
    assert (len(words) - 30_000, 30_000, 3) in found


def test_query(spark):
    """The registered query on the smallest tables, worked out here from its contract."""
    from thermogrid.llm.queries import QUERIES

    folder, want = "/root/testdata/sf0.001", []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = [(s, m, q) for s, m, q in quick(words)]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((r.doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(words, runs)))))
    got = QUERIES["op11_periodic_runs"](spark, folder).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[1] for w in want)


def quick(words):
    """As brute, with a period's stretches found by numpy: the texts are long."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, found = np.array([number[w] for w in words], np.int64), set()
    for q in range(1, len(ids) // 4 + 1):
        same = np.diff(np.concatenate([[0], ids[q:] == ids[:-q], [0]]).astype(np.int8))
        for s, e in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if e - s + q >= max(6, 4 * q) and not any((s, e - s + q) == x[:2] and q % x[2] == 0 for x in found):
                found.add((s, e - s + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))
