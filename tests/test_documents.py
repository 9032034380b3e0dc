"""The document front end: issues by path, recovery and repair, files as sources and sinks."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from semaphora.operators import documents as D
from semaphora.plans import documents as P
from semaphora.sources import files


@pytest.mark.parametrize("name", sorted(P.SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{sf}/orders.parquet'")
    df, run = P.QUERIES[name](spark, sf), con.execute(P.SQL[name])
    columns = [d[0] for d in run.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str(list(r)) for r in run.fetchall())


def test_repair(spark):
    cases = [('{"a": [1, {"b": 2}, {"c', '{"a": [1, {"b": 2}]}'), ('{"a": "x} \\" {", "b": [3], "c": "unterm', '{"a": "x} \\" {", "b": [3]}'), ('{"a": "never', None), ("no object", None), ("", None), (None, None), ('so: {"a": {}} and more }', '{"a": {}}'), ("{]", None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", D.repaired("t").alias("r")).collect()
    assert {r["i"]: r["r"] for r in rows} == {i: w for i, (_, w) in enumerate(cases)}


def test_repaired_text_is_a_prefix_that_decodes(spark, sf):
    for r in P.repair_json(spark, sf).filter("body is not null").collect():
        assert isinstance(json.loads(r["body"]), dict)


def test_null_empty_and_no_bodies(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "null")], "doc int, body string")
    assert [(r["doc"], r["path"]) for r in D.schema_issues(df).orderBy("doc").collect()] == [(1, ""), (2, ""), (3, "")]
    assert D.recovered(df).count() == D.schema_issues(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.createDataFrame([("b", None), ("a", "MIT")], "source_id string, license string")
    files.write_lines(rows, f"{at}/s", order="source_id")
    assert [r["source_id"] for r in files.read_lines(spark, f"{at}/s", files.SOURCES).collect()] == ["a", "b"]
    assert files.read_lines(spark, f"{at}/none", files.PREDICTIONS, missing_is_empty=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_lines(spark, f"{at}/none", files.MANIFEST)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.json").write_text("{broken\n")
    found = D.schema_issues(files.documents(spark, f"{at}/docs")).select(F.element_at(F.split("doc", "/"), -1).alias("f"), "path").collect()
    assert [tuple(r) for r in found] == [("x.json", "")]
