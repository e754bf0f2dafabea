from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage gets and gives."""
    import corpus_pipeline as P
    from thermogrid.llm.tables import documents, written

    docs, out = documents(spark, FOLDER), []
    for name, stage in P.STAGES:
        after = written(stage(spark, docs, FOLDER), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(spark, steps):
    assert [s[0] for s in steps] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    for _, before, after in steps[:-1]:
        assert sorted(after.columns) == sorted(before.columns)
    assert steps[-1][2].columns == ["doc_id", "start", "n_tokens", "ids"]


def test_quality_and_groups(steps):
    from test_jaccard import brute

    (_, raw, good), (_, _, single), *_ = steps
    words = {r.doc_id: len((r.text or "").split()) for r in raw.collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert all(words[i] >= 50 for i in kept) and len(kept) > 0.5 * len(words)
    want = {d for d, _, c in brute(sorted(kept.items())) if d == c}
    assert sorted(r.doc_id for r in single.collect()) == sorted(want)


def test_clean_texts(spark, steps):
    from test_decontamination import brute

    _, before, after = steps[2]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in before.collect()}
    hits = {i: (n, h) for i, n, h, _ in brute(list(texts.items()), items)}
    left = {r.doc_id: r for r in after.collect()}
    assert any(h for _, h in hits.values())
    assert set(texts) - set(left) == {i for i, (n, h) in hits.items() if h > 0.5 * n}
    assert all(r.text == texts[i] for i, r in left.items() if not hits[i][1])
    assert all(not h for _, _, h, _ in brute([(i, r.text) for i, r in left.items()], items))
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_mixed_and_tokens(steps):
    from collections import Counter

    from test_mixing import WORD, water

    _, before, after = steps[3]
    size = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in before.collect()}
    total, taken = Counter(), Counter()
    for s, n in size.values():
        total[s] += n
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 2
    for i, k in copies.items():
        taken[size[i][0]] += k * size[i][1]
    target, largest = water(total, 1.5, 2.0), max(n for _, n in size.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in total)
    rows = sorted(steps[4][2].collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in rows) == copies and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in rows)
