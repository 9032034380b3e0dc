"""Sinks that a restart may repeat, and running a stream over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def into(folder: str):
    """A function for foreachBatch: each batch has a folder of its own, which a repeated batch replaces. So a batch that
    a crash repeats is neither lost nor doubled."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return put


def run(stream: DataFrame, mode: str, folder: str, checkpoint: str | None = None) -> None:
    """Runs a stream over what is there now into folder, from where the checkpoint left off."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(into(folder))
    writer.option("checkpointLocation", checkpoint or f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, schema, folder: str) -> DataFrame:
    """What all batches have put there, with the number of the batch."""
    return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long"))


def appended(spark: SparkSession, schema, folder: str) -> DataFrame:
    """The rows of a stream in append mode."""
    return read(spark, schema, folder).drop("batch")


def updated(spark: SparkSession, schema, folder: str, keys: list[str]) -> DataFrame:
    """The rows of a stream in update mode: of each key the one of the last batch."""
    rows = read(spark, schema, folder)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*(c for c in rows.columns if c != "batch"))


def replaced(spark: SparkSession, schema, folder: str) -> DataFrame:
    """The rows of a stream in complete mode: those of the last batch."""
    rows = read(spark, schema, folder)
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")


def drained(spark: SparkSession, stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """The result of a stream over what is there now, by way of a table in the shared folder."""
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    run(stream, mode, folder)
    if mode == "update":
        return updated(spark, stream.schema, folder, keys)
    return (replaced if mode == "complete" else appended)(spark, stream.schema, folder)
