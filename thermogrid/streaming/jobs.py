"""Starting a stream, draining it, and reading what it wrote. Outputs and checkpoints live in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermogrid.operators.keyed import latest_per_key
from thermogrid.session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def append_and_read(stream: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """Run an append-mode stream over everything available and read its output."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, label)
    run = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def each_batch_and_read(stream: DataFrame, label: str, transform: Callable[[DataFrame], DataFrame], mode: str = "update", base: str | None = None) -> DataFrame:
    """Run `transform` on every micro-batch and keep each result under its batch number.

    A batch that is tried again writes the same place again, so a restart neither loses nor doubles rows.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    run = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def newest_version(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last state of every key over all batches of an update-mode stream."""
    return latest_per_key(changes.withColumn("batch", F.col("batch").cast("long")), keys, "batch").drop("batch")
