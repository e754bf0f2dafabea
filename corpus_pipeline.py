"""From raw documents to token ids, in five stages; each takes and, but for the last, returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermogrid.llm.decontamination import decontaminate
from thermogrid.llm.jaccard_join import keep_one_of_each
from thermogrid.llm.mixing import mixed
from thermogrid.llm.quality import passing
from thermogrid.llm.tables import documents, scratch_path, small_batches, written
from thermogrid.llm.token_output import read_tokens, write_tokens

#: No part of this can be said in SQL as a whole: vocabularies, the cube method's draws, token ids.
ORACLE_SQL = None


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    small_batches(spark)
    return passing(docs, _vocabulary("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly such passages goes."""
    small_batches(spark)
    clean = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their target shares; a document stands there as often as it is taken."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in ascending id order and read back: doc_id, start, n_tokens, ids."""
    small_batches(spark)
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, _vocabulary("byte_bpe_50k.json"))
    return read_tokens(spark, path)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
