"""The shape of documents by batch against the same as expressions, on documents that are wrong in many ways."""

import json
import random

from pyspark.sql import functions as F

from semaphora.operators import documents as D
from semaphora.operators import recovery
from semaphora.scene import SCENE

from .test_recovery import BASE, RIGHT

VALUES = [
    None, True, 0, 1, -1, 1.0, 0.5, 1.5, 2**63, 2**63 - 1, 10**40, -0.0, 1e300, "", "a", "a\n", "a\r\n", "a ", "-a", "A", "toe", "v0", "joint", "straight", "x" * 64, "x" * 65, "é", [], [1, 2], [1, "A"], [0.5, True], [1, 2, 3, 4],
    ["A", "B"], [["A", "B"]], [["A"]], [[1, 2], [3, 4.5]], [[1, None]], [None], ["n1"], ["n 1"], {}, {"a": 1}, {"-": "straight"}, {"n1": "straight"}, {"n1": ["A", "D"]}, {"n1": {}}, {"é": {}},
]
FULL = {
    **RIGHT, "schema_version": "v0",
    "derailers": [{"id": "d1", "at": {"edge": "m0", "offset": 0.5, "direction": "b_to_a"}, "confidence": 1}],
    "routes": [{"id": "r1", "start": "s1", "end": "n2", "path": ["m0"], "switch_positions": {"n2": "straight", "n1": ["A", "C"]}}],
    "state": {"switches": {"n2": {"position": None, "active_paths": [["A", "C"]]}}, "signals": {"s1": {"aspect": "stop"}}, "tracks": {"m0": {"occupancy": "free", "route_set": False}}, "derailers": {"d1": {}}, "routes": {"r1": {"status": "set"}}, "observed_at_ms": 5},
}
#: Texts that JSON parsers differ about.
TEXTS = [
    "", " ", "null", "1", '"x"', "[]", "{}", " \n{}", "{} {}", "{}x", '{"a":1,"a":2}', '{"meta":{"a":1,"a":2}}', '{"meta":NaN}', '{"meta":-Infinity}', '{"meta":01}', '{"meta":1.}', '{"meta":+1}', '{"meta":{"a":1,}}', "{'a':1}", '{"a":"\t"}', '{"a":"\\x"}',
    '{"\\ud800":1}', '{"state":{"tracks":{"\\ud800":{}}}}', '{"meta":' + '{"a":' * 1000 + "1" + "}" * 1002, '{"meta":' + "[" * 3000 + "]" * 3000 + "}", '{"meta":{"a":1e999}}', '{"observed":1e5}', "﻿{}", '{"scene_id":"a"', "{broken", "[1, 2]",
]


def places(value, way=()):
    yield way
    for k, x in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from places(x, (*way, k))


def spoilt(rng):
    some = lambda: json.loads(json.dumps(rng.choice(VALUES)))
    doc = json.loads(json.dumps(FULL))
    for _ in range(rng.choice([1, 1, 2, 4])):
        way = rng.choice([w for w in places(doc) if w])
        at = doc
        for k in way[:-1]:
            at = at[k]
        kind = rng.random()
        if kind < 0.15:
            del at[way[-1]]
        elif kind < 0.25 and isinstance(at, dict):
            at[rng.choice(["more", "", "-", "id", "geometry", "confidence"])] = some()
        else:
            at[way[-1]] = some()
    return json.dumps(doc)


def test_paths_are_those_of_the_expressions(spark):
    rng = random.Random(11)
    texts = [*TEXTS, json.dumps(FULL), None, *(spoilt(rng) for _ in range(600))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, body string").repartition(8)
    by_expression = F.array_sort(F.array_distinct(D._object(F.try_parse_json("body"), D.SCENE, F.lit(""))))
    got = {r.doc: r.p for r in rows.select("doc", D.shape_problems(F.col("body")).alias("p")).collect()}
    want = {r.doc: r.p for r in rows.select("doc", by_expression.alias("p")).collect()}
    assert {texts[k]: got[k] for k in want if got[k] != want[k]} == {} and len(got) == len(texts)
    assert sum(p == [] for p in got.values()) > 10


def test_bytes_that_are_no_text(spark):
    rows = spark.sql("""SELECT cast(concat(cast('{"meta":{"a":"' AS binary), X'ff', cast('"},"' AS binary), X'c3', cast('":1}' AS binary)) AS string) AS body""")
    assert rows.select(D.shape_problems(F.col("body")).alias("p")).first().p == [""]


def test_shapes_are_not_looked_up_field_by_field(spark):
    """An expression for each field of each object took some 3 ms a document, and 12 s to plan."""
    rows = spark.createDataFrame([("a", "{}", 1.0, None)], "doc string, answer string, scale double, b string").withColumn("base", F.from_json("b", SCENE))
    for df in (recovery.lenient_documents(rows), rows.select(D.shape_problems(F.col("answer")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "try_variant_get" not in plan.lower() and "schema_of_variant" not in plan.lower()


def test_kept_elements_are_those_that_recovery_by_expression_keeps(spark):
    rng = random.Random(12)
    texts = [*(t for t in TEXTS if "\\ud800" not in t), *(spoilt(rng) for _ in range(300))]
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc int, answer string, scale double").withColumn("base", F.from_json(F.lit(json.dumps(BASE)), SCENE)).repartition(8)
    of = lambda s: {"topology/nodes": s.topology.nodes, "topology/edges": s.topology.edges, "signals": s.signals, "derailers": s.derailers, "routes": s.routes}
    scenes = {r.doc: r.scene for r in recovery.lenient_documents(rows).collect()}
    got = {(doc, f, e.id) for doc, s in scenes.items() if s for f, items in of(s).items() for e in items}
    want = {(r.doc, r.family, json.loads(r.element)["id"]) for r in D.recovered(rows.select("doc", F.to_json(recovery.object_in(F.col("answer"))).alias("body"))).collect()}
    assert got == {w for w in want if scenes[w[0]]} and len(got) > 500
