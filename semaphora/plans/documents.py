"""Queries of the document front end, over documents written out from orders; the key's residue modulo 8 names a fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D

# {0} to {4}: what the faults replace.
_BODY = '{{"schema_version":"v0",{0}"source":{{"kind":"synthetic","image":"a.png","width":{1},"height":400}},"provenance":{{"kind":"prediction"}},"topology":{{"nodes":[{{"id":"n1","kind":"boundary"}},{{"id":"n2","kind":"{2}"}}],"edges":[{{"id":"m0","a":{{"node":"n1","port":"A"}},"b":{{"node":"n2","port":"{3}"}}}}]}},"state":{{"tracks":{{"{4}":{{"occupancy":"free"}}}}}}}}'
_FAULTS = {0: {}, 3: {0: '"more":1,"scene_id":"s",'}, 4: {2: "turnout"}, 5: {0: ""}, 6: {1: "0", 3: "Q"}, 7: {4: "-bad"}}
_RIGHT = ['"scene_id":"s",', "800", "joint", "A", "m0"]


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    doc = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc"))
    k = F.pmod("doc", F.lit(8))
    body = F.when(k == 1, "{broken").when(k == 2, "[1, 2]")
    for fault, changes in _FAULTS.items():
        body = body.when(k == fault, _BODY.format(*(changes.get(i, r) for i, r in enumerate(_RIGHT))))
    return doc.withColumn("body", body)


def validate_files(spark: SparkSession, sf: str) -> DataFrame:
    return D.schema_issues(_bodies(spark, sf))


def lenient_recover(spark: SparkSession, sf: str) -> DataFrame:
    return D.recovered(_bodies(spark, sf)).select("doc", "family", "idx", F.get_json_object("element", "$.id").alias("id"))


def repair_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every body cut off at a place that the key names, repaired, and what elements it still gives."""
    cut = _bodies(spark, sf).select("doc", F.expr("left(body, cast(150 + doc % 250 as int))").alias("text"))
    return cut.select("doc", D.repaired("text").alias("body"))


def rescale_geometry(spark: SparkSession, sf: str) -> DataFrame:
    doc = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc"))
    box = F.array(*((F.pmod("doc", F.lit(n))).cast("double") for n in (101, 211, 307, 401)))
    return doc.select("doc", D.rescaled(box, F.lit(1.5)).alias("b")).select("doc", *(F.col("b")[i].alias(f"c{i}") for i in range(4)))


QUERIES = {f.__name__: f for f in (validate_files, lenient_recover, repair_json, rescale_geometry)}
SQL = {
    "validate_files": """SELECT o_orderkey AS doc, 'SCHEMA_INVALID' AS code, f.path FROM orders JOIN (VALUES (1, ''), (2, ''), (3, ''), (4, 'topology/nodes/1/kind'), (5, ''),
      (6, 'source/width'), (6, 'topology/edges/0/b/port'), (7, 'state/tracks/-bad')) AS f(k, path) ON f.k = o_orderkey % 8""",
    "lenient_recover": """SELECT o_orderkey AS doc, e.family, CAST(e.idx AS INTEGER) AS idx, e.id FROM orders JOIN (VALUES ('topology/nodes', 0, 'n1', -1), ('topology/nodes', 1, 'n2', 4), ('topology/edges', 0, 'm0', 6)) AS e(family, idx, id, lost)
      ON o_orderkey % 8 NOT IN (1, 2) AND o_orderkey % 8 <> e.lost""",
    "rescale_geometry": "SELECT o_orderkey AS doc, " + ", ".join(f"CAST(o_orderkey % {n} * 1.5 AS DOUBLE) AS c{i}" for i, n in enumerate((101, 211, 307, 401))) + " FROM orders",
}
