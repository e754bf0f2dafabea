from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from samples import prose, thue_morse

from thermogrid.llm.suffix_dedup import remove_repeats, segments


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if times[b[k : k + length]] > 1:
                gone[k + 1 : k + length + 1] = True
        edge = np.diff(gone.astype(np.int8))
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(spark):
    shared, other = prose(60, 900), prose(45, 901)
    rows = [(i, prose(20 + 9 * i % 140, i)) for i in range(25)]
    rows += [(100 + i, prose(15, 200 + i) + " " + shared[i % 9 : len(shared) - i % 5] + " " + prose(12 + i, 300 + i)) for i in range(14)]
    rows += [(200, other + "|" + other), (201, other), (202, "é" * 150), (203, "a" * 900), (204, "ab" * 300), (205, "a" * 201), (206, "x" + "a" * 199)]
    rows += [(207, None), (208, ""), (209, "short"), rows[3], rows[3], (None, rows[4][1]), (None, "lonely " * 3)]
    rows += [(300 + i, "common passage of some length here, " * 2 + prose(25, 400 + i)) for i in range(12)]
    return rows


@pytest.mark.parametrize("length,shard", [(200, 1 << 20), (200, 500), (50, 1 << 20), (20, 3000)])
def test_against_brute_force(spark, length, shard):
    rows = rows_of(spark)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, spans int").repartition(3)
    got = remove_repeats(docs, length, shard_bytes=shard).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute(rows, length)


@pytest.mark.parametrize("length", [200, 1024])
def test_strings_that_a_weak_hash_would_confuse(spark, length):
    a, b = thue_morse()
    rows = [(1, a), (2, b), (3, "x" + b + "y"), (4, a[:1023])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, spans int")
    got = remove_repeats(docs, length).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute(rows, length)


def test_every_string_start_is_in_one_run():
    draw = np.random.default_rng(2)
    texts = [bytes(draw.integers(97, 97 + k, n).tolist()) for k, n in ((3, 900), (26, 700), (1, 600), (2, 10), (26, 199), (26, 200))]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    first, count, key, _, _ = segments(data, offsets, 200)
    seen, at = Counter(), {}
    for f, n, k in zip(first.tolist(), count.tolist(), key.tolist()):
        for i in range(f, f + n):
            seen[i] += 1
            at.setdefault(bytes(data[i : i + 200]), set()).add(k)
    assert sorted(seen) == [i for a, e in zip(offsets, offsets[1:]) for i in range(a, e - 199)]
    assert set(seen.values()) == {1} and all(len(x) == 1 for x in at.values())


def test_passage_shorter_than_a_string(spark, monkeypatch):
    from thermogrid.llm import suffix_dedup as S

    make = S._sorter

    def limited(length):
        sort = make(length)

        def check(table):
            sizes = {}
            for k, p in zip(table.column("key").to_pylist(), table.column("part").to_pylist()):
                sizes[k] = sizes.get(k, 0) + len(p)
            if max(sizes.values()) > 5000:
                raise ValueError(f"{max(sizes.values())} bytes of one key in one shard")
            return sort(table)

        return check

    monkeypatch.setattr(S, "_sorter", limited)
    notice = prose(30, 950)[:150].ljust(150, "x")
    rows = [(i, prose(30, 1000 + i) + notice + prose(30, 2000 + i)) for i in range(60)]
    rows += [(100 + i, prose(30, 3000 + i) + "some more before it, 50 bytes " + notice + " and more after it, 50 bytes" + prose(30, 4000 + i)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(docs, 200, shard_bytes=5000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == (want := brute(rows, 200))
    assert sum(x[2] > 0 for x in want) == 3


def test_nothing_long_enough(spark):
    got = remove_repeats(spark.createDataFrame([(1, "short"), (2, "short"), (3, None)], "doc_id long, text string"), 200).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(1, 5, 0, 0), (2, 5, 0, 0), (3, 0, 0, 0)]


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).count() == 0
