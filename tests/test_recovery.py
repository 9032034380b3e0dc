"""Recovery of documents from answers: what is dropped and kept, defaults, rescaling at any depth, header, errors."""

import json

import pytest
from pyspark.sql import functions as F

from semaphora.operators import recovery
from semaphora.scene import SCENE

RIGHT = {
    "schema_version": "v9",
    "scene_id": "theirs",
    "source": {"kind": "synthetic", "image": "x", "width": 1, "height": 1},
    "provenance": {"kind": "ground_truth"},
    "topology": {
        "nodes": [{"id": "n1", "kind": "boundary", "geometry": {"point": [10, 20.25]}}, {"id": "n2", "kind": "joint", "geometry": {"bbox": [1, 2, 3, 4]}}],
        "edges": [{"id": "m0", "a": {"node": "n1", "port": "A"}, "b": {"node": "n2", "port": "A"}, "geometry": {"polyline": [[0, 0], [5, 5]]}}],
    },
    "signals": [{"id": "s1", "kind": "main", "at": {"edge": "m0", "direction": "a_to_b"}}],
    "routes": [{"id": "r1", "start": "s1", "end": "n2", "path": ["m0"]}],
    "state": {"signals": {"s1": {"raw": "Hp0"}}, "tracks": {"m0": {"occupancy": "free"}}},
    "meta": {"station": "X", "bbox": [1]},
}
BASE = {"schema_version": "v0", "scene_id": "ours", "source": {"kind": "panel_photo", "image": "i.png", "width": 800, "height": 400}, "provenance": {"kind": "prediction", "run_id": "r"}}


def changed(**paths):
    doc = json.loads(json.dumps(RIGHT))
    for path, value in paths.items():
        at = doc
        *way, last = path.split("__")
        for name in way:
            at = at[int(name)] if isinstance(at, list) else at[name]
        at[int(last) if isinstance(at, list) else last] = value
    return json.dumps(doc)


ANSWERS = {
    "right": changed(),
    "node": changed(topology__nodes__0__kind="teleporter"),
    "state": changed(state__signals__s1={"aspect": "maybe"}),
    "key": changed(state__tracks={"-": {"occupancy": "free"}}),
    "bad key": changed(state__tracks={"-": {"occupancy": "?"}}),
    "lists": changed(topology="none", signals={}, routes=None, meta=[1], state=3),
    "cut": changed()[: changed().index('"routes"') + 12],
    "prose": "Sure!\n```json\n" + changed() + "\n```",
    "none": "no json", "broken": "{broken", "list": "[1, 2]", "null": None, "empty": "", "no scale": changed(), "no base": changed(),
}


@pytest.fixture(scope="module")
def lenient(spark):
    rows = [(k, a, None if k == "no scale" else 2.0, None if k == "no base" else json.dumps(BASE)) for k, a in ANSWERS.items()]
    df = spark.createDataFrame(rows, "doc string, answer string, scale double, b string").select("doc", "answer", "scale", F.from_json("b", SCENE).alias("base"))
    return {r["doc"]: r["scene"] for r in recovery.lenient_documents(df.unionAll(df.limit(1))).collect()}


def test_lenient(lenient):
    s = lenient["right"]
    assert (s["scene_id"], s["schema_version"], s["source"]["image"], s["provenance"]["run_id"]) == ("ours", "v0", "i.png", "r")
    n1, n2 = s["topology"]["nodes"]
    assert (n1["geometry"]["point"], n2["geometry"]["bbox"], s["topology"]["edges"][0]["geometry"]["polyline"]) == ([20, 40.5], [2, 4, 6, 8], [[0, 0], [10, 10]])
    assert (n1["half_labels"], s["topology"]["edges"][0]["kind"], s["signals"][0]["at"]["offset"], s["routes"][0]["switch_positions"]) == ([], "unknown", 0.5, {})
    assert s["state"]["signals"]["s1"]["aspect"] == "unknown" and s["state"]["signals"]["s1"]["raw"] == "Hp0"
    assert s["meta"] == {"station": "X", "bbox": "[2]"}
    assert [n["id"] for n in lenient["node"]["topology"]["nodes"]] == ["n2"] and len(lenient["node"]["topology"]["edges"]) == 1
    assert lenient["state"]["state"]["signals"] == {} and len(lenient["state"]["signals"]) == 1
    assert lenient["key"] is None and lenient["bad key"]["state"]["tracks"] == {}
    t = lenient["lists"]
    assert (t["topology"]["nodes"], t["topology"]["edges"], t["signals"], t["routes"], t["state"]["tracks"], t["meta"]) == ([], [], [], [], {}, {})
    cut = lenient["cut"]
    assert (len(cut["topology"]["nodes"]), len(cut["signals"]), len(cut["routes"]), cut["state"]["tracks"]) == (2, 1, 0, {})
    assert lenient["prose"] == lenient["right"]
    for k in ("none", "broken", "list", "null", "empty", "no scale", "no base"):
        assert lenient[k] is None, k


def test_annotations(spark):
    rows = [(k, a, None if k == "no scale" else 0.5, "ours", "m1", "r1") for k, a in ANSWERS.items()]
    df = spark.createDataFrame(rows, "doc string, answer string, scale double, scene_id string, model_id string, run_id string")
    source = F.struct(F.lit("panel_photo").alias("kind"), F.lit("i.png").alias("image"), F.lit(800).alias("width"), F.lit(400).alias("height"))
    got = {r["doc"]: r for r in recovery.annotations(df.withColumn("source", source)).collect()}
    assert all((r["annotation"] is None) != (r["error"] is None) for r in got.values())
    a = json.loads(got["right"]["annotation"])
    assert (a["schema_version"], a["scene_id"], a["source"]["image"], a["provenance"]) == ("v0", "ours", "i.png", {"kind": "prediction", "model_id": "m1", "run_id": "r1"})
    assert a["topology"]["nodes"][0]["geometry"]["point"] == [5, 10.1] and a["signals"] == RIGHT["signals"]
    assert got["prose"]["annotation"] == got["right"]["annotation"]
    errors = {k: r["error"] for k, r in got.items()}
    assert errors["node"] == "schema: 1 error(s); first: at topology/nodes/0/kind"
    assert errors["state"] == "schema: 1 error(s); first: at state/signals/s1/aspect"
    assert errors["lists"].startswith("schema: 5 error(s); first: at meta")
    assert errors["none"] == errors["null"] == errors["empty"] == errors["list"] == errors["broken"] == "no JSON object in the answer"
    assert errors["cut"] == "invalid JSON" and errors["no scale"] == "no scale"


def test_rescaling_at_any_depth(spark):
    doc = {"geometry": {"point": [10, True, "x", None, [1.26, {"a": 3}]], "bbox": 7, "polyline": {"point": [1]}}, "at": {"offset": 0.5}, "nested": [{"deep": {"bbox": [0.25, 2.55]}}], "n": 3, "point": 2.04}
    rows = [(json.dumps(doc), 0.5), (None, 1.0), ("{}", None), ("{nope", 2.0), ("[1, [2]]", 2.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, s double").select(recovery.rescaled_text("t", "s")).collect()]
    want = {"geometry": {"point": [5.0, True, "x", None, [0.6, {"a": 3}]], "bbox": 3.5, "polyline": {"point": [1]}}, "at": {"offset": 0.5}, "nested": [{"deep": {"bbox": [0.1, 1.3]}}], "n": 3, "point": 1.0}
    assert json.loads(got[0]) == want and got[1:4] == [None] * 3 and json.loads(got[4]) == [1, [2]]
