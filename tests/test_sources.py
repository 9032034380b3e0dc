"""Sources and sinks: file order over many splits, strict reads, listings, a database by JDBC, the kept schema."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from semaphora.sources import files, jdbc, json_schema


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_lines_are_numbered_in_file_order(spark, folder):
    want = []
    for name in ("a", "b", "c"):
        with open(f"{folder}/{name}.jsonl", "w") as f:
            for i in range(3000 if name != "b" else 0):
                line = json.dumps({"scene_id": f"{name}{i}", "width": i, "pad": "x" * (i * 37 % 200)})
                want.append(line)
                f.write(line + "\n" + ("  \n\n" if i % 7 == 0 else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = files.numbered_lines(spark, folder)
        assert spark.read.text(folder).rdd.getNumPartitions() > 20
        assert [(r["seq"], r["line"]) for r in sorted(lines.collect())] == list(enumerate(want))
        read = files.read_manifest(spark, f"{folder}/a.jsonl", "scene_id string, width int")
        assert [(r["seq"], r["scene_id"]) for r in sorted(read.collect())] == [(i, f"a{i}") for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    with open(f"{folder}/d.jsonl", "w") as f:
        f.write('{"scene_id": "x"}\nno json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_manifest(spark, f"{folder}/d.jsonl").collect()


RIGHT = {"schema_version": "v0", "scene_id": "s", "source": {"kind": "synthetic", "image": "i", "width": 1, "height": 1}, "provenance": {"kind": "prediction"}, "topology": {"nodes": [{"id": "n", "kind": "joint", "label": "Ü"}]}, "state": {}}


def test_documents_strict_and_indented(spark, folder):
    docs = spark.createDataFrame([("a", json.dumps(RIGHT)), ("b", json.dumps({**RIGHT, "scene_id": "t"}))], "doc string, body string")
    files.write_documents(docs, f"{folder}/out")
    files.write_documents(docs.filter("doc = 'b'"), f"{folder}/out")
    rows = {r["scene"]["scene_id"]: r for r in files.read_document(spark, f"{folder}/out").collect()}
    assert rows["s"]["body"] == json.dumps(RIGHT, indent=2, ensure_ascii=False) + "\n" and set(rows) == {"s", "t"}
    os.makedirs(f"{folder}/bad")
    with open(f"{folder}/bad/c.json", "w") as f:
        f.write(json.dumps({**RIGHT, "more": 1}))
    with pytest.raises(Exception, match="no scene document at"):
        files.read_document(spark, f"{folder}/bad").collect()
    assert files.read_document(spark, f"{folder}/bad", strict=False).first()["scene"]["scene_id"] == "s"
    assert [r[0] for r in files.listed(spark, f"{folder}/bad").collect()] == ["c"] and files.listed(spark, f"{folder}/none").collect() == []


def test_import_from_a_database(spark, folder):
    """Licence and status are filtered, hashes held to the files, content once; a second import changes nothing."""
    import hashlib

    os.makedirs(f"{folder}/db/img")
    contents = {f"img/{i}.JPG": f"image {i % 8}".encode() for i in range(12)}
    for path, content in contents.items():
        with open(f"{folder}/db/{path}", "wb") as f:
            f.write(content)
    url, driver = f"jdbc:derby:{folder}/derby;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = []
    for i in range(14):
        path = f"img/{i}.JPG"
        sha = hashlib.sha256(contents.get(path, b"")).hexdigest() if i != 5 else "0" * 64
        rows.append((i, path, sha, "CC BY 4.0" if i != 3 else "GFDL", "accepted" if i != 4 else "pending", 10 + i, 20, f"File:{i}", "u", "f", "<b>Ann &amp; Bo</b>", "c", "", "d", "t", "2024"))
    schema = "id long, path string, sha256 string, license string, status string, width int, height int, commons_title string, source_url string, file_url string, author string, credit string, license_url string, description string, search_term string, ingested_at string"
    spark.createDataFrame(rows, schema).write.format("jdbc").options(url=url, dbtable="images", driver=driver, createTableColumnTypes=", ".join(f"{c.split()[0]} varchar(200)" for c in schema.split(", ") if c.endswith("string"))).save()
    images = jdbc.read_table(spark, url, "images", parts=4, driver=driver)
    assert images.rdd.getNumPartitions() == 4 and images.count() == 14
    images = images.toDF(*(c.lower() for c in images.columns))
    records, rejected = jdbc.importable(images, jdbc.hashed_files(spark, f"{folder}/db"))
    assert {(r["id"], r["reason"]) for r in rejected.collect()} == {(5, "the file has another hash"), (12, "no such file"), (13, "no such file")}
    got = {r["title"]: r for r in records.collect()}
    assert sorted(got) == ["File:10", "File:11", "File:6", "File:7", "File:8", "File:9"]  # 0, 1 and 2 are the contents of 8, 9 and 10; 3 and 4 aren't wanted, 11 has the content of 3
    one = got["File:10"]
    assert (one["license"], one["author"], one["image"]) == ("CC-BY-4.0", "Ann & Bo", f"images/{one['source_id']}.jpg") and one["source_id"] == f"commons-{one['sha256'][:12]}"
    known = spark.createDataFrame([("commons-other", "kept"), (one["source_id"], "old")], "source_id string, title string")
    once = jdbc.upserted(known, records)
    assert once.count() == 7 and once.filter("title = 'old'").count() == 0
    twice = jdbc.upserted(once, records)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.select(*twice.columns).collect()))


def test_schema_and_its_drift(spark, folder):
    schema = json.loads(json_schema.text())
    node = schema["properties"]["topology"]["properties"]["nodes"]["items"]
    assert node["required"] == ["id", "kind"] and "dkw" in node["properties"]["kind"]["enum"] and schema["additionalProperties"] is False
    assert schema["properties"]["state"]["properties"]["tracks"]["additionalProperties"]["properties"]["occupancy"] == {"enum": ["free", "occupied", "unknown"]}
    json_schema.write(spark, f"{folder}/schema")
    assert spark.read.text(f"{folder}/schema", wholetext=True).first()[0] == json_schema.text() == json_schema.text()
    assert json_schema.drift(spark, f"{folder}/schema").collect() == []
    os.makedirs(f"{folder}/old")
    with open(f"{folder}/old/v0.json", "w") as f:
        f.write(json_schema.text().replace('"boundary"', '"border"', 1))
    with open(f"{folder}/old/v1.json", "w") as f:
        f.write(json_schema.text() + "\n")
    found = json_schema.drift(spark, f"{folder}/old").orderBy("file").collect()
    assert [(r["kept"].strip(), r["now"] and r["now"].strip()) for r in found] == [('"border",', '"boundary",'), ("", None)]
