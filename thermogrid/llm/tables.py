"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermogrid.session import scratch_path


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there: a lost executor cannot change or restart them."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: str) -> F.Column:
    """A-Z lowered and nothing else."""
    c = F.col(text)
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that move to and from a Python worker at once, for tables of texts: the usual ten thousand hold tens of megabytes on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(rows, int(spark.conf.get(key)) or rows)))
