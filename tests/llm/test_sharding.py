from __future__ import annotations

import zlib

import pytest
from samples import prose

from thermogrid.llm.sharding import prefix_shards


def brute(rows, shards):
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, crc(r[1]), size(r[1])))
    total, before, slots, out = sum(size(t) for _, t in rows), 0, [0] * shards, []
    for i, t in rows:
        k = min((2 * before + size(t)) * shards // (2 * total), shards - 1)
        out.append((i, size(t), crc(t), k, slots[k]))
        slots[k] += 1
        before += size(t)
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_against_brute_force(odd_docs, shards):
    got = prefix_shards(odd_docs, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], shards)


def test_balance_and_order(spark):
    docs = spark.createDataFrame([(i, prose(20 + i % 37, i)) for i in range(600)], "doc_id long, text string").repartition(5)
    got = prefix_shards(docs, 8).orderBy("doc_id").collect()
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    sums = [sum(r["size"] for r in got if r.shard == k) for k in range(8)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got)


def test_empty_table(no_docs):
    assert prefix_shards(no_docs, 8).count() == 0
    with pytest.raises(ValueError):
        prefix_shards(no_docs, 0)
