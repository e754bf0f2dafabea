from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import ODD, prose  # noqa: E402

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, prose with copies and ties, extra columns under names that the operators use inside."""
    texts = [*ODD, *(prose(30 + 17 * i, i) for i in range(12)), prose(60, 3), prose(60, 3), prose(60, 3) + " tail", "Line one\nShared line\n" + prose(5, 9)]
    texts += [f"own {i}\n  SHARED line \nend {i % 3}" for i in range(12)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "ä"][i % 4], None if t is None else len(t), i, "k") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "a row without an id", "en", "a", 3, 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos int, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, pos int, key string")
