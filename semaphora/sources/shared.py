"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is named, a local session (tests, a laptop) gets a temporary
    folder, which is then set; on a cluster, whose nodes do not share such a folder, that is an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        path = f"file://{tempfile.mkdtemp(prefix='semaphora-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: later plans start there, and a lost executor loses nothing.

    The table stays until removed() or until the folder is cleared: results that are read later may need it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/semaphora/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for t in tables:
        if path := t.__dict__.pop("_written_to", None):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
