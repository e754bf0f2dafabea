from __future__ import annotations

import hashlib
import re

import pytest
from samples import prose, thue_morse

from thermogrid.llm.unit_dedup import keep_earliest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


FORMS = {"lines": r"[^\n]*\n|[^\n]+\Z", "paragraphs": r"(?s).*?\n\n+|.+\Z", "sentences": r"[^\n]*?(?:[.!?]+[ \t]+|\n)|[^\n]+\Z"}


def brute(rows, least, kind, run_words):
    """Rows in rank order; ids differ here, or else the whole row does not."""
    cut, first, places = {}, {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        at, own = 0, []
        for u in re.findall(FORMS[kind], t or ""):
            key, end = tuple(WORD.findall(u.translate(LOW))), at + len(u.encode())
            own.append((u, key if len(key) >= least else None, at, end))
            if len(key) >= least:
                first.setdefault(key, (i, at))
                places[key] = places.get(key, 0) + 1
            at = end
        cut[i, t] = own
    out = []
    for i, t in rows:
        own, run, runs = cut[i, t], [], []
        for u in [x for x in own if x[1] is not None] + [("", (), 0, 0)]:
            if u[1] and places[u[1]] > 1:
                run.append(u)
            else:
                runs, run = runs + [run], []
        runs = [r for r in runs if r and sum(len(u[1]) for u in r) >= run_words]
        gone = {u[2:] for r in runs for u in r if first[u[1]] != (i, u[2])}
        text = "".join(u[0] for u in own if u[2:] not in gone)
        if kind == "lines" and gone and max(gone)[1] == len((t or "").encode()) and not t.endswith("\n"):
            text = text.removesuffix("\n")
        out.append((i, len(runs), sorted(gone), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,kind,run_words", [(1, "lines", 1), (4, "lines", 1), (10, "lines", 1), (3, "paragraphs", 1), (1, "sentences", 1), (1, "sentences", 14), (2, "lines", 20)])
def test_against_brute_force(spark, least, kind, run_words):
    shared = [prose(12, 50 + k) for k in range(4)]
    rows = [(40 - i, "\n".join([f"head {i}", shared[i % 4], prose(9, i), shared[(i + 1) % 4].upper(), ""][: 3 + i % 3])) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, f"{shared[0]}\n\n{shared[0]}\n\n\nlast one here\n"), (104, f"é {shared[1]}\n  {shared[1]}\t"), (105, shared[2]), (106, "last   one\tHERE"), (None, shared[3]), (107, shared[3]), (107, shared[3])]
    passage = "Here it starts. A second one follows!  And a third?\tNow the fourth... is here. It ends 3.5 words on. "
    rows += [(110, "own words first. " + passage + "tail"), (111, "other start " + passage + "other end"), (112, "  . \n" + passage), (113, "A second one follows! alone."), (114, "x. \ny?  \n z"), (115, " . lead")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, removed string").repartition(3)
    got = [(r.doc_id, r.n_passages, [(s.start, s.end) for s in r.removed], r.kept_sha256) for r in keep_earliest(docs, least, kind, run_words).collect()]
    assert sorted(got, key=repr) == brute(rows, least, kind, run_words)


def test_words_that_a_weak_hash_would_confuse(spark):
    a, b = thue_morse()
    rows = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{b} {a}")]
    got = [(r.doc_id, r.n_passages, [(s.start, s.end) for s in r.removed], r.kept_sha256) for r in keep_earliest(spark.createDataFrame(rows, "doc_id long, text string"), 1, "lines", 1).collect()]
    assert sorted(got, key=repr) == brute(rows, 1, "lines", 1)


def test_odd_and_empty(odd_docs, no_docs):
    got = keep_earliest(odd_docs, 1).collect()
    assert len(got) == odd_docs.count()
    assert all(r.n_removed == len(r.removed) and hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert keep_earliest(no_docs).count() == 0
