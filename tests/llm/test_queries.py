"""The registered queries on the smallest tables: SQL twins, columns, and who imports what."""

from __future__ import annotations

from pathlib import Path

import pytest
from check import compare, connect

from thermogrid.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
COLUMNS = {
    "op1": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op2": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4": ["doc_id", "n_shingles", "component_id"],
    "op5": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6": ["doc_id", "n_passages", "n_removed", "kept_sha256"],
    "op7": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9": ["doc_id", "size", "source_size", "target", "taken"],
    "op10": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12": ["item_id", "rank", "doc_id", "score"],
    "op13": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    cursor = connect(FOLDER).execute(SQL[name])
    assert compare(df.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) is None and rows


def test_names_and_columns(spark):
    named = {q.split("_")[0]: q for q in QUERIES}
    assert set(named) == set(COLUMNS)
    for n in ("op5", "op9", "op10", "op11", "op13"):
        assert set(COLUMNS[n]) <= set(QUERIES[named[n]](spark, FOLDER).columns)


def test_nothing_else_imports_the_package():
    others = [p for p in ROOT.rglob("*.py") if "llm" not in p.parts and p.name not in ("__spark_entry__.py", "corpus_pipeline.py")]
    assert others and not [p for p in others if "thermogrid.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]


def test_entry_has_them():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
