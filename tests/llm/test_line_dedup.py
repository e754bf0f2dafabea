from __future__ import annotations

from collections import Counter

from thermogrid.llm.line_dedup import drop_common_lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOW)


def brute(rows, least, min_chars=1):
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(docs, least, **more):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in drop_common_lines(docs, least, **more).collect()), key=repr)


def test_against_brute_force(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for least in (2, 10):
        assert run(odd_docs, least) == brute(rows, least)
    assert run(odd_docs, 2, min_chars=6) == brute(rows, 2, 6)


def test_long_document(spark):
    text = "\n".join(f"line {i % 7} {i if i % 2 else ''}" for i in range(40_000))
    rows = [(i, text) for i in range(3)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), 3) == brute(rows, 3)


def test_empty_table(no_docs):
    assert run(no_docs, 10) == []


def test_no_python_in_the_plan(odd_docs):
    plan = drop_common_lines(odd_docs, 10)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
