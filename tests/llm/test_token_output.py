from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from samples import thue_morse
from tokenizers import Tokenizer

from thermogrid.llm.tables import scratch_path
from thermogrid.llm.token_output import read_tokens, token_digests, write_tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")


def run(spark, docs, file=FILE):
    path = scratch_path(spark, "test-tokens")
    write_tokens(docs, path, file)
    return read_tokens(spark, path), path


def test_round_trip(spark, odd_docs):
    tokenizer = Tokenizer.from_file(FILE)
    tokens, path = run(spark, odd_docs)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()))
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for _, _, t in rows]
    got = sorted(tokens.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i if has else None for has, i, _ in rows]
    for r, ids, (_, _, text) in zip(got, want, rows):
        assert r.ids == ids, text
    assert [r.start for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_digests(tokens).collect()}
    assert sums == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_any_text_is_cut_safely(spark):
    """Random strings over characters that matter to the pattern."""
    tokenizer = Tokenizer.from_file(FILE)
    draw, letters = np.random.default_rng(5), ["a", "Be", " ", " ", "\n", "\t", "'", "'s", "1", ".", "é", " ", " ", "　", "\u0085", "漢", "\x1c", "\x7f", "ll", "<|endoftext|>", "<|", "|>"]
    texts = ["".join(letters[k] for k in draw.integers(0, len(letters), draw.integers(0, 40))) for _ in range(3000)]
    tokens, _ = run(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in tokens.collect():
        assert r.ids[:-1] == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, repr(texts[r.doc_id])


def test_special_tokens_long_words_and_other_files(spark):
    """End-of-text marks are one id; two long words that polynomial hashes confuse stay apart; another kind of file gets whole texts."""
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>1", "<|endoftext", " ".join(thue_morse()), "", "Ünï  Code\n\nTWO"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for file in (FILE, public_tokenizers.path("word_bpe_49k.json")):
        tokenizer = Tokenizer.from_file(file)
        for r in run(spark, docs, file)[0].collect():
            assert r.ids[:-1] == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, (file, r.doc_id)
    assert Tokenizer.from_file(FILE).encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_files(spark, odd_docs):
    """Pages have an index and dictionary encoding; counting reads no ids."""
    import glob

    import pyarrow.parquet as pq

    tokens, path = run(spark, odd_docs)
    files = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
    column = next(c for f in files for c in [pq.ParquetFile(f).metadata.row_group(0).column(4)] if pq.ParquetFile(f).metadata.num_rows)
    assert "RLE_DICTIONARY" in column.encodings and column.has_offset_index
    assert "ids" not in tokens.select("n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_empty_table(spark, no_docs):
    tokens, _ = run(spark, no_docs)
    assert token_digests(tokens).count() == 0
