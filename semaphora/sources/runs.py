"""Folders of a run and of a data set: where everything lies, and the sinks of a run's rows.

Paths are those of any file system Spark can write to. A name like metrics.parquet is what Spark makes of it: a folder of
part files, written anew as a whole when a stage is repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

# Names in the folder of a run and of a data set.
RUN_LAYOUT = {"config": "run.yaml", "predictions": "predictions.jsonl", "metrics": "metrics.parquet", "summary": "summary.json", "report": "report.html"}
SPLIT_LAYOUT = {"manifest": "gt/{split}/manifest.jsonl", "truth": "gt/{split}/{scene_id}.json", "drafts": "review/{split}/drafts", "work": "review/{split}/work"}

METRICS = "model string, mode string, scene_id string, metric string, part string, value double, n bigint"


def run_path(root: str, run_id: str, what: str | None = None) -> str:
    """The folder of a run, or the place of one of its parts (a key of RUN_LAYOUT)."""
    if not run_id or "/" in run_id or run_id in (".", ".."):
        raise ValueError(f"no name of a run: {run_id!r}")
    folder = f"{root.rstrip('/')}/{run_id}"
    return folder if what is None else f"{folder}/{RUN_LAYOUT[what]}"


def split_path(data: str, split: str, what: str, scene_id: str | None = None) -> str:
    """The place of a part (a key of SPLIT_LAYOUT) of a split; 'truth' needs the scene."""
    if what == "truth" and not scene_id:
        raise ValueError("the truth is a file for each scene")
    return f"{data.rstrip('/')}/{SPLIT_LAYOUT[what].format(split=split, scene_id=scene_id)}"


def append_predictions(rows: DataFrame, root: str, run_id: str) -> None:
    """Adds rows of files.PREDICTIONS to the run's log; what is there stays."""
    files.write_lines(rows, run_path(root, run_id, "predictions"), append=True)


def read_predictions(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The run's log; empty before the first row."""
    return files.read_lines(spark, run_path(root, run_id, "predictions"), files.PREDICTIONS, missing_is_empty=True)


def last_attempts(log: DataFrame) -> DataFrame:
    """Of a log the row of the highest attempt of each (scene_id, model, mode); of equal attempts one that has a
    document. A log has no order of its own once it is many files."""
    keys = ["scene_id", "model", "mode"]
    rest = [c for c in log.columns if c not in keys]
    order = F.struct(F.coalesce("attempt", F.lit(0)), F.col("annotation").isNotNull(), F.coalesce("latency_ms", F.lit(0.0)))
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def log_metrics(log: DataFrame) -> DataFrame:
    """Rows of METRICS that the log tells, for each scene's last attempt: success, latency, tokens and cost. What an
    attempt doesn't tell has no row; cost and tokens are of all attempts, since all are paid for."""
    last = last_attempts(log)
    value = lambda c: F.col(c).cast("double")
    told = lambda rows, **cols: rows.select("model", "mode", "scene_id", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), c.alias("value")) for k, c in cols.items()))).alias("m"))
    paid = log.groupBy("model", "mode", "scene_id").agg(*(F.sum(c).alias(c) for c in ("cost_usd", "tokens_in", "tokens_out")))
    rows = told(last, success=F.col("annotation").isNotNull().cast("double"), latency_ms=value("latency_ms"))
    rows = rows.unionByName(told(paid, cost_usd=value("cost_usd"), tokens_in=value("tokens_in"), tokens_out=value("tokens_out")))
    return rows.filter("m.value is not null").select("model", "mode", "scene_id", "m.metric", F.lit("all").alias("part"), "m.value", F.lit(1).cast("long").alias("n"))


def tally_metrics(tallies: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of METRICS from tallies of operators.evaluation (doc, model_no, metric, part, hits, of). names: (doc, model_no,
    scene_id, model, mode), a row for each document; a tally of nothing has no value."""
    value = F.col("hits") / F.nullif("of", F.lit(0))
    return tallies.join(names, ["doc", "model_no"]).select("model", "mode", "scene_id", "metric", "part", value.alias("value"), F.col("of").alias("n"))


def write_metrics(rows: DataFrame, root: str, run_id: str) -> None:
    """The run's rows of METRICS, instead of those there are: to repeat an evaluation is to write the same again."""
    columns = [c.split()[0] for c in METRICS.split(", ")]
    rows.select(*columns).repartitionByRange("model", "metric", "scene_id").sortWithinPartitions("model", "metric", "scene_id").write.mode("overwrite").parquet(run_path(root, run_id, "metrics"))


def read_metrics(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The run's rows of METRICS; empty before they are written."""
    try:
        return spark.read.schema(METRICS).parquet(run_path(root, run_id, "metrics"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], METRICS)


def summary(metrics: DataFrame) -> DataFrame:
    """(model, mode, metric, part, value, p50, p95, total, scenes, rank) of rows of METRICS: the mean weighted by n (so
    that shares add up as tallies do), percentiles over scenes, and the rank of a model in its metric, larger values
    first. As many rows as there are models, modes, metrics and parts."""
    rows = metrics.filter("value is not null").groupBy("model", "mode", "metric", "part").agg(
        (F.sum(F.col("value") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("value"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("_p"),
        F.sum("value").alias("total"), F.count_distinct("scene_id").alias("scenes"),
    )
    rank = F.rank().over(Window.partitionBy("metric", "part").orderBy(F.desc("value")))
    figure = lambda c: F.round(c, 9)
    return rows.select("model", "mode", "metric", "part", figure(F.col("value")).alias("value"), figure(F.col("_p")[0]).alias("p50"), figure(F.col("_p")[1]).alias("p95"), figure(F.col("total")).alias("total"), "scenes", rank.alias("rank"))


def write_summary(rows: DataFrame, root: str, run_id: str) -> None:
    """summary() as JSON lines, sorted, in one part: its rows do not grow with scenes."""
    rows.coalesce(1).sortWithinPartitions("metric", "part", "rank", "model", "mode").write.mode("overwrite").option("ignoreNullFields", "false").json(run_path(root, run_id, "summary"))
