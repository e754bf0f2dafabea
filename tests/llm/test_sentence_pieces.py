"""Ids and decoded texts against the library on whole texts."""

from __future__ import annotations

import public_tokenizers
import pytest
from samples import ODD, prose

from thermogrid.llm import sentence_pieces as S

FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    *ODD, "▁", "▁x a", "a▁b", " lead", "trail ", "  both  ", "a  b   c    d", "<s> x </s> <unk> <0x0A>", "nul\x00 in", "� é  　 x",
    "中文字" * 900, "no" * 4000, "ab\n" * 3000, " " * 5000, "x" + " " * 77 + "y", "\U0001f469‍\U0001f4bb " * 50, *(prose(40 + 90 * i, i) for i in range(8)),
]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.mark.parametrize("limit", [7, 64, 1 << 20])
def test_chunks_against_library(model, limit, monkeypatch):
    monkeypatch.setattr(S, "KEPT", 50 if limit < 100 else S.KEPT)  # the table starts afresh often
    monkeypatch.setattr(S, "LONG", 100)
    table = S.ChunkTable(S.Chunker(FILE))
    got = {}
    for first, ids, offsets in S._blocks(table, TEXTS, limit):
        for k in range(len(offsets) - 1):
            got[first + k] = ids[offsets[k] : offsets[k + 1]].tolist()
    assert [got[i] for i in range(len(TEXTS))] == [model.encode(t or "") for t in TEXTS]


def test_each_distinct_chunk_once():
    table = S.ChunkTable(S.Chunker(FILE))
    texts = ["one two one", "two three  four", "one", "  four one"] * 5
    list(S._blocks(table, texts, 10))
    assert table.segmented == len(table.slot) == 5  # one, two, three, and four after two markers, in front or between


def test_rows(spark, model, odd_docs, no_docs):
    rows = [(i, t, "ids", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 0), (3, "again", "x", 0), (3, "again", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids long").repartition(3)
    for slices in (16, 1 << 20):
        got = sorted(S.decode(S.encode(docs, FILE, slice_chars=slices), FILE, slices).collect(), key=repr)
        ids = [(d, model.encode(t or "")) for d, t, *_ in rows]
        want = sorted([(d, x, model.decode(x)) for d, x in ids], key=repr)
        assert sorted([(r.doc_id, list(r.ids), r.decoded) for r in got], key=repr) == want
    assert S.encode(odd_docs, FILE).count() == odd_docs.count()
    assert S.decode(S.encode(no_docs, FILE), FILE).count() == 0


def test_query(spark):
    import hashlib

    import sentencepiece

    from thermogrid.llm.queries import QUERIES

    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    folder = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = model.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op13_sentence_pieces"](spark, folder).collect())) == sorted(want)


def test_long_text(model):
    text = prose(2000, 4) + " " + "ab" * 30_000 + "\n" + prose(200_000, 5)
    table = S.ChunkTable(S.Chunker(FILE))
    ((_, ids, _),) = S._blocks(table, [text], 1 << 16)
    assert ids.tolist() == model.encode(text)
