"""Files as sources and sinks: a document a file, and JSON lines of manifests, source records and predictions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "scene_id string, split string, partition string, difficulty string, source_kind string, image string, gt string, width int, height int, license string, license_url string, author string, source_url string, panel_group string, quality map<string,double>"
SOURCES = "source_id string, status string, image string, sha256 string, width int, height int, title string, source_url string, file_url string, author string, credit string, license string, license_name string, license_url string, description string, search_term string, display_title string, display_url string, panel_group string, curation_note string, modification string, blur_regions array<array<int>>, ingested_at string"
PREDICTIONS = "scene_id string, run_id string, model string, mode string, attempt int, latency_ms double, tokens_in bigint, tokens_out bigint, cost_usd double, raw_text string, annotation string, parse_error string, validation string"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc (the file's path) and body of every file below folder."""
    return spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("body"))


def read_lines(spark: SparkSession, path: str, schema: str, missing_is_empty: bool = False) -> DataFrame:
    """JSON lines of a fixed schema; blank lines are skipped. A missing file is an error, or an empty table if asked."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if missing_is_empty and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_lines(df: DataFrame, path: str, order: str | None = None, append: bool = False) -> None:
    """JSON lines with nulls kept. With order the parts are range-sorted by it, so that their names' order is its order."""
    rows = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(*sorted(df.columns)) if order else df
    rows.write.mode("append" if append else "errorifexists").option("ignoreNullFields", "false").json(path)


def listed(spark: SparkSession, folder: str, pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """scene_id of the files below folder whose path matches; contents aren't read. A missing folder has none."""
    try:
        paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "scene_id string")
    return paths.select(F.regexp_extract("path", pattern, 1).alias("scene_id")).filter("scene_id <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line): the lines of text files that aren't blank, numbered from 0 in file order, files in order of their names.

    A file is read in splits by many tasks. A first pass counts the lines of each split, prefix sums of the counts give
    where each begins, and a line's place in its split is told by Spark's ids, which ascend within a task. What is
    ordered in one place is a row for each split, never the lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = lines.filter(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return rows.join(F.broadcast(splits), ["file", "block"]).select((F.col("before") + F.col("n") - F.col("first")).alias("seq"), F.col("value").alias("line"))


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """JSON lines of a manifest with seq, their place in it. A line that is no JSON object is an error."""
    rows = numbered_lines(spark, path)
    return rows.select("seq", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("seq", "r.*")


def read_document(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(doc, scene, body) of the document files at path. strict: a document whose shape is wrong is an error."""
    from ..operators.documents import shape_problems
    from ..scene import SCENE

    rows = documents(spark, path)
    wrong = F.concat_ws(", ", shape_problems(F.col("body")))
    sound = F.when(F.size(shape_problems(F.col("body"))) > 0, F.raise_error(F.concat(F.col("doc"), F.lit(": no scene document at: "), wrong)).cast("string")).otherwise(F.col("body")) if strict else F.col("body")
    return rows.select("doc", "body", F.from_json(sound, SCENE).alias("scene"))


@F.pandas_udf(T.StringType())
def indented(body: pd.Series) -> pd.Series:
    """JSON texts with two spaces a level, keys as they come; null for null."""
    return body.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False), na_action="ignore")


def write_documents(docs: DataFrame, folder: str, body: str = "body") -> None:
    """Each document (doc, body) as indented JSON in a file of its own, folder/doc=<doc>/part-*: writing again replaces
    the documents that are written, and no others."""
    rows = docs.select("doc", indented(F.col(body)).alias("value"))
    rows.write.partitionBy("doc").option("lineSep", "\n").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(folder)
