"""Import of curated images from a database: read in parts by JDBC, held to the hashes of their files, put among the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.licences import licence_url, plain_html, spdx_id
from ..functions.scenes import source_id


def read_table(spark: SparkSession, url: str, table: str, key: str = "id", parts: int = 8, **options: str) -> DataFrame:
    """A table by JDBC in parts of its numeric key; what filters the database can do, Spark hands to it.

    The bounds are the least and largest key, for which a first pass reads the keys alone; rows without key are in the
    first part. options: of the connection, such as driver and user."""
    jdbc = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    whole = jdbc.load()
    lo, hi = whole.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return whole
    return jdbc.options(partitionColumn=key, lowerBound=int(lo), upperBound=int(hi) + 1, numPartitions=parts).load()


def hashed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path below folder, sha256) of every file; contents stay in the tasks that read them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.split("://")[-1].removeprefix("file:").rstrip("/")
    below = F.regexp_replace("path", f"^[a-z0-9]*:?(//)?{base}/", "")
    return rows.select(below.alias("path"), F.sha2("content", 256).alias("sha256"))


def importable(images: DataFrame, files: DataFrame, statuses: tuple[str, ...] = ("accepted",)) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of images (a table of the curation database) and files (path, sha256).

    Taken are rows of an allowed licence and a wanted status. One whose file is missing, or has another hash than the
    database says, is rejected with the reason: (id, path, reason). Of rows of one content that of the largest id counts.
    Columns: those of files.SOURCES that a database has."""
    wanted = images.withColumn("_spdx", spdx_id(F.col("license"))).filter(F.col("_spdx").isNotNull() & F.col("status").isin(*statuses))
    found = files.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha256"))
    rows = wanted.join(found, F.col("path") == F.col("_path"), "left")
    reason = F.when(F.col("_sha256").isNull(), "no such file").when(~F.col("_sha256").eqNullSafe(F.lower("sha256")), "the file has another hash")
    rows = rows.withColumn("_reason", reason)
    rejected = rows.filter(F.col("_reason").isNotNull()).select("id", "path", F.col("_reason").alias("reason"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    own = {
        "source_id": source_id(F.col("_sha256")), "status": F.col("status"), "image": F.concat(F.lit("images/"), source_id(F.col("_sha256")), suffix), "sha256": F.col("_sha256"),
        "width": F.col("width"), "height": F.col("height"), "title": F.col("commons_title"), "source_url": F.col("source_url"), "file_url": F.col("file_url"), "author": plain_html(F.col("author")),
        "credit": plain_html(F.col("credit")), "license": F.col("_spdx"), "license_name": F.col("license"), "license_url": licence_url(F.col("license"), F.col("license_url")),
        "description": plain_html(F.col("description")), "search_term": F.col("search_term"), "ingested_at": F.col("ingested_at"),
    }
    good = rows.filter(F.col("_reason").isNull()).select(F.col("id").alias("_id"), *(c.alias(n) for n, c in own.items()))
    last = good.groupBy("source_id").agg(F.max_by(F.struct(*(n for n in own if n != "source_id")), "_id").alias("_r"))
    return last.select("source_id", "_r.*"), rejected


def upserted(known: DataFrame, imported: DataFrame) -> DataFrame:
    """Known source records with the imported ones in place of those of equal source_id; columns that an import doesn't
    have are null in its rows."""
    return known.join(imported.select("source_id"), "source_id", "left_anti").unionByName(imported, allowMissingColumns=True)
