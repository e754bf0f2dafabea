"""One registered query per operator over the given tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermogrid.llm.tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return keep


@_register("op1_line_dedup", """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN c USING (key) GROUP BY doc_id""")
def op1_line_dedup(spark, folder):
    from thermogrid.llm.line_dedup import drop_common_lines

    return drop_common_lines(documents(spark, folder)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@_register("op9_cube_mixing")
def op9_cube_mixing(spark, folder):
    from thermogrid.llm.mixing import cube_mix

    return cube_mix(documents(spark, folder)).select("doc_id", "source", "size", "source_size", "target", "taken")


@_register("op10_prefix_sharding")
def op10_prefix_sharding(spark, folder):
    from thermogrid.llm.sharding import prefix_shards

    placed = prefix_shards(documents(spark, folder), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_register("op3_decontamination", """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    n AS (SELECT *, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
    g AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
    ks AS (SELECT DISTINCT k FROM n),
    o AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
    m AS (SELECT o.doc_id, o.k, o.i, g.item_id FROM o JOIN g USING (k, gram)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op3_decontamination(spark, folder):
    from thermogrid.llm.decontamination import find_contamination, names_digest

    found = find_contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", names_digest(F.col("items")).alias("items_sha256"), "contaminated")


@_register("op5_tokenizer_fertility")
def op5_tokenizer_fertility(spark, folder):
    import public_tokenizers

    from thermogrid.llm.quality import quality

    return quality(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model")).drop("lang", "tie")


@_register("op8_token_output")
def op8_token_output(spark, folder):
    import public_tokenizers

    from thermogrid.llm.tables import scratch_path
    from thermogrid.llm.token_output import read_tokens, token_digests, write_tokens

    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, folder), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(read_tokens(spark, path))


@_register("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark, folder):
    from thermogrid.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, folder))


@_register("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark, folder):
    from thermogrid.llm.jaccard_join import near_duplicates

    return near_duplicates(documents(spark, folder))


@_register("op2_lm_scoring")
def op2_lm_scoring(spark, folder):
    from thermogrid.llm.language_model import score_texts

    return score_texts(documents(spark, folder))


@_register("op6_unit_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*?(?:[.!?]+[ \\t]+|\\n|$)') AS us FROM documents),
    u AS (SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS pos FROM d),
    k AS (SELECT *, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w,
        sum(strlen(unit)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM u),
    r AS (SELECT *, count(*) OVER (PARTITION BY w) > 1 AS again, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1 AS later,
        row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM k WHERE len(w) > 0),
    i AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, again ORDER BY seq) AS island FROM r),
    p AS (SELECT *, again AND sum(len(w)) OVER (PARTITION BY doc_id, again, island) >= 40 AS passage FROM i),
    a AS (SELECT k.doc_id, count(*) FILTER (WHERE passage AND later) AS n_removed, count(DISTINCT island) FILTER (WHERE passage) AS n_passages,
        coalesce(string_agg(k.unit, '' ORDER BY k.pos) FILTER (WHERE NOT coalesce(passage AND later, false)), '') AS kept,
        coalesce(string_agg(CAST(CAST(k.upto - strlen(k.unit) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(k.upto AS BIGINT) AS VARCHAR), ',' ORDER BY k.pos) FILTER (WHERE passage AND later), '') AS removed
        FROM k LEFT JOIN p ON p.doc_id = k.doc_id AND p.pos = k.pos GROUP BY k.doc_id)
    SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, coalesce(n_passages, 0) AS n_passages, coalesce(n_removed, 0) AS n_removed,
        CAST(strlen(text) - strlen(coalesce(kept, '')) AS BIGINT) AS bytes_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(removed, '') AS removed
    FROM d LEFT JOIN a USING (doc_id)""")
def op6_unit_dedup(spark, folder):
    from thermogrid.llm.unit_dedup import keep_earliest

    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return keep_earliest(documents(spark, folder)).drop("kept_text").withColumn("removed", spans)


@_register("op13_sentence_pieces")
def op13_sentence_pieces(spark, folder):
    import public_tokenizers

    from thermogrid.llm.sentence_pieces import decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(documents(spark, folder), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_register("op12_lexical_search", """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
    i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
    t AS (SELECT doc_id, CAST(len AS BIGINT) AS len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    s AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len * c.n) // c.l)) AS part FROM t, c),
    g AS (SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * c.n + 2) / (2 * df + 1))) AS BIGINT) * part) AS BIGINT) AS score
        FROM i JOIN s USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""")
def op12_lexical_search(spark, folder):
    from thermogrid.llm.lexical_search import search

    return search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@_register("op11_periodic_runs")
def op11_periodic_runs(spark, folder):
    from thermogrid.llm.periodic_runs import find_runs

    # A tenth of the texts repeat themselves from some word on, as the contract has it.
    docs = documents(spark, folder).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    some = docs.where("h % 10 = 0 AND text IS NOT NULL").select("doc_id", "text", words.alias("words"), F.floor(F.col("h") / 10).alias("g"))
    some = some.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("transform(sequence(0, n - 1), i -> words[CAST(if(i >= a, a + (i - a) % p, i) AS INT)])")
    repeated = some.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).alias("text"))
    plain = docs.where("h IS NULL OR h % 10 <> 0 OR text IS NULL").select("doc_id", "text")
    runs = find_runs(plain.unionByName(repeated))
    longest = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN CAST(sign(y.length - x.length) AS INT) WHEN x.start <> y.start THEN CAST(sign(x.start - y.start) AS INT) ELSE CAST(sign(x.period - y.period) AS INT) END)")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    best = F.try_element_at(longest, F.lit(1))
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
