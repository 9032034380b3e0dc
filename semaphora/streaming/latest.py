"""The prediction log as a stream: what is last for each pair, counters and latency histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import drained

#: Upper edges of latency buckets, in milliseconds; what is above the last is in a bucket of its own.
EDGES_MS = [50.0, 100.0, 250.0, 500.0, 1_000.0, 2_500.0, 5_000.0, 10_000.0, 60_000.0]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def latest_of_stream(spark: SparkSession, sf_dir: str, log_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """State: one row for each (scene_id, model), the one of the largest seq, so late rows change nothing."""
    log = log_of(_events(spark, sf_dir))
    rows = log.groupBy("scene_id", "model").agg(F.max("seq").alias("seq"), F.max_by("ok", "seq").alias("ok"))
    return drained(spark, rows, "update", "latest", ["scene_id", "model"])


def counters_of_stream(spark: SparkSession, sf_dir: str, log_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = log_of(_events(spark, sf_dir)).groupBy("model").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    return drained(spark, rows, "complete", "counters")


def bucket(value: Column, edges: list[float] = EDGES_MS) -> Column:
    """The least edge that a value doesn't exceed; infinity above all of them, null for null."""
    found = F.lit(float("inf"))
    for e in reversed(edges):
        found = F.when(value <= e, F.lit(e)).otherwise(found)
    return F.when(value.isNotNull(), found)


def frame_counters(log: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", edges: list[float] = EDGES_MS) -> DataFrame:
    """Latency histogram, frames, tokens and cost by window of event time, model, mode and status, of a table or stream.

    log: time, model, mode, status, latency_ms, tokens_in, tokens_out, cost_usd. A row for each bucket that has frames,
    in which n counts them; rows without latency are in the bucket null. One aggregate: a hot model is folded before
    the shuffle, and the state of a stream is the buckets of the windows that are open. Rows later than late behind the
    newest are dropped by the watermark of a stream; rows without a time are dropped."""
    rows = log.filter(F.col(time).isNotNull())
    rows = rows.withWatermark(time, late) if log.isStreaming else rows
    sums = [F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cost_usd")]
    by = [F.window(time, width).alias("w"), "model", "mode", "status", bucket(F.col("latency_ms"), edges).alias("le")]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency_ms"), *sums)
    return out.select(F.col("w.start").alias("begin"), *out.columns[1:])


def counters_by_window(spark: SparkSession, sf_dir: str, log_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = frame_counters(log_of(_events(spark, sf_dir)), width="1 day")
    return drained(spark, rows, "update", "histogram", ["begin", "model", "mode", "status", "le"])
