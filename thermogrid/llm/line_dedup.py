"""Lines that many documents share, dropped from all of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from thermogrid.llm.tables import ascii_lower, written

_BLANK = " \t\n\x0b\f\r"


def _key(line: Column) -> Column:
    """128 bits of a normalised line; its hash is taken twice with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def _runs_kept(both: Column) -> Column:
    """The lines left when the sorted positions `drop` are cut out: the runs between one dropped position and the next."""
    n = F.size(both["drop"])

    def run(j: Column) -> Column:
        left = F.when(j == 0, F.lit(-1)).otherwise(F.get(both["drop"], j - 1))
        right = F.when(j == n, F.size(both["lines"])).otherwise(F.get(both["drop"], j))
        return F.slice(both["lines"], left + 2, right - left - 1)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), run)), "\n")


def drop_common_lines(
    docs: DataFrame, min_documents: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, `kept_text`, `n_lines` (before), `n_dropped`.

    A text is split at \\n (null or empty: one empty line). A line's key is the line without white space at its ends and with A-Z
    lowered. A key of at least `min_chars` characters in at least `min_documents` documents loses all its lines everywhere.
    Every row counts as one document, also where ids or whole rows repeat or the id is null; an empty table gives no rows.

    Plan: keys are made distinct within a document before they are exploded, so a count of rows is a count of documents and
    partial sums meet a common key once per task. The common keys are written to the shared folder; a join with them (in which
    Spark splits a common key's rows, both sides being plain exchanges) leaves positions only, and texts move once.
    """
    if min_documents < 1 or min_chars < 1:
        raise ValueError("min_documents and min_chars start at 1")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # Rows that agree in id and text lose the same lines, so the pair is identity enough to put a document together again.
    identity = [F.col("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")]
    lines = F.split(ascii_lower("text"), "\n")
    keys = F.transform(lines, lambda x: F.trim(x, F.lit(_BLANK)))
    keyed = base.select(*identity, keys.alias("keys"))
    distinct = keyed.select(
        F.explode(F.array_distinct(F.transform(F.filter("keys", lambda k: F.char_length(k) >= min_chars), _key))).alias("key")
    )
    common = distinct.groupBy(F.col("key.a").alias("a"), F.col("key.b").alias("b")).count().where(F.col("count") >= min_documents)
    common = written(common.select("a", "b"), "common-lines")
    # A repeated row would double its positions; one copy of each is enough.
    placed = keyed.select("doc_id", "t1", "t2", F.posexplode("keys").alias("pos", "key")).where(F.char_length("key") >= min_chars)
    placed = placed.select("doc_id", "t1", "t2", "pos", _key(F.col("key")).alias("k")).select("*", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
    hits = placed.join(common, ["a", "b"]).groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    d, h = base.select("text", *identity).alias("d"), hits.alias("h")
    met = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.t1") == F.col("h.t1")) & (F.col("d.t2") == F.col("h.t2")), "left")
    # The one-element array makes the split and the positions values of a lambda variable, computed once per document.
    both = F.array(F.struct(F.split("d.text", "\n").alias("lines"), F.coalesce("h.drop", F.array().cast("array<int>")).alias("drop")))
    out = F.transform(both, lambda x: F.struct(_runs_kept(x).alias("kept_text"), F.size(x["lines"]).cast("long").alias("n_lines"), F.size(x["drop"]).cast("long").alias("n_dropped")))
    return met.select(F.col("d.doc_id").alias("doc_id"), F.get(out, F.lit(0)).alias("r")).select("doc_id", "r.*")
