"""The prediction log: append-only rows, one for each attempt, with seq in the order of writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """The last row of each (scene_id, model). An aggregate, so a hot pair is folded before the shuffle."""
    rest = [c for c in log.columns if c not in ("scene_id", "model")]
    rows = log.groupBy("scene_id", "model").agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
    return rows.select("scene_id", "model", "_last.*")


def open_jobs(scenes: DataFrame, models: list[str], log: DataFrame, retry_failed: bool = True) -> DataFrame:
    """What a resumed run has to do: scene_id, model, attempt. models is a short list from the configuration."""
    jobs = scenes.select("scene_id").distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    last = log.groupBy("scene_id", "model").agg(F.max_by("ok", "seq").alias("ok"), F.count("*").alias("n"))
    rows = jobs.join(last, ["scene_id", "model"], "left")
    due = F.col("n").isNull() | (F.lit(retry_failed) & ~F.col("ok"))
    return rows.filter(due).select("scene_id", "model", (F.coalesce("n", F.lit(0)) + 1).alias("attempt"))


def first_scenes(scenes: DataFrame, condition, order: str, limit: int) -> DataFrame:
    """Filter, then the first limit rows in file order."""
    return scenes.filter(condition).orderBy(order).limit(limit)


def majority(votes: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group with its share; of equally frequent ones the one seen first. Null is a value."""
    counts = votes.groupBy(*group, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = counts.groupBy(*group).agg(F.min_by(F.struct(value), F.struct(-F.col("_n"), F.col("_first"))).alias("_best"), F.max("_n").alias("_top"), F.sum("_n").alias("of"))
    return best.select(*group, F.col(f"_best.{value}").alias(value), F.col("_top").alias("support"), "of", (F.col("_top") / F.col("of")).alias("share"))


def ranked(metrics: DataFrame, by: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Rank of each row among those of its metric, larger values first."""
    w = Window.partitionBy(metric).orderBy(F.desc(value))
    return metrics.select(*by, metric, value, F.rank().over(w).alias("rank"))
