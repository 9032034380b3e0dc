"""The scene corpus: clean scenes have no issue, every fault has its own; kernels against brute force."""

import itertools
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from semaphora import rules
from semaphora.operators import matching, validator
from semaphora.plans import all_queries, all_sql
from semaphora.sources.bridge import scenes

#: What each fault has to give at least, in scenes where it applies.
CODES = {3: "TOPO_DEGREE", 4: "TOPO_DANGLING_REF", 5: "TOPO_PORT_UNKNOWN", 6: "TOPO_SELF_LOOP", 7: "TOPO_DANGLING_REF", 8: "ID_DUPLICATE", 9: "NODE_HALF_LABELS_UNEXPECTED", 10: "GEOM_OUT_OF_BOUNDS", 11: "STATE_PATH_NOT_ALLOWED", 12: "STATE_UNKNOWN_ELEMENT", 13: "STATE_MISSING", 14: "STATE_WRONG_FIELD_FOR_KIND", 15: "ROUTE_START_NOT_SIGNAL", 16: "ROUTE_DISCONTIGUOUS", 17: "ROUTE_SWITCH_MISMATCH", 18: "ROUTE_SWITCH_MISSING", 19: "ROUTE_SWITCH_MISMATCH"}


def test_faults_give_their_codes_and_clean_scenes_none(spark, sf):
    c = scenes(spark, sf)
    found = {(r["fault"], r["code"]) for r in validator.exploded(validator.validate(c)).select((F.col("doc") % 20).alias("fault"), "code").distinct().collect()}
    assert not {f for f, _ in found} & {0, 1, 2}
    assert {(f, code) for f, code in CODES.items()} <= found
    strict = {r["code"] for r in validator.exploded(validator.validate(c, True)).filter("severity = 'warning'").select("code").distinct().collect()}
    assert strict == {"NODE_HALF_LABELS_UNEXPECTED"}


@pytest.mark.parametrize("name", ["rule1_dup_ids", "rule6_degree", "rule13_route_walk", "endpoints", "topology_jaccard", "cluster_support", "latest_attempt", "stream_latest", "ingest_funnel", "spdx_id", "label_cer"])
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "events", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = all_queries()[name](spark, sf)
    run = con.execute(all_sql()[name])
    columns = [d[0] for d in run.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(str([plain(v) for v in r]) for r in run.fetchall())


def test_assignment_is_the_optimum():
    draw = np.random.default_rng(2)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        cost = draw.random((n, m)).round(2)
        pairs = matching.assign(cost, 10.0)
        assert len(pairs) == min(n, m) and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        small, large = (cost, range(m)) if n <= m else (cost.T, range(n))
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(large, min(n, m)))
        assert sum(cost[a, b] for a, b in pairs) == pytest.approx(best)
    assert matching.assign(np.zeros((0, 3))) == [] and matching.assign(np.array([[0.9]]), 0.6) == []


def test_match_with_itself_is_the_identity(spark):
    rows = [(1, i, f"n{i}", f"W{i}", "joint", 100.0 * i, 50.0) for i in range(6)]
    e = spark.createDataFrame(rows, "doc long, idx int, id string, label string, kind string, x double, y double")
    out = matching.matches(matching.costs(e, e, 894.0)).collect()
    assert [(r["t_id"], r["p_id"]) for r in sorted(out, key=lambda r: r["t_idx"])] == [(f"n{i}", f"n{i}") for i in range(6)]
    copies = e.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("model_no")))
    found = matching.clusters(copies, 894.0).groupBy("cluster_no").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert len(found) == 6 and all(r["n"] == 3 and r["ids"] == 1 for r in found)


def test_path_sets(spark):
    cases = [("dkw", ["A-C", "B-D"], True), ("dkw", ["A-D", "B-C"], True), ("dkw", ["A-C", "A-D"], False), ("ekw", ["B-C"], False), ("ekw", [], True), ("ekw", ["A-C", "A-C"], False), ("switch", ["straight-toe"], False)]
    df = spark.createDataFrame(cases, "kind string, paths array<string>, want boolean").withColumn("got", validator.path_set_allowed(F.col("kind"), F.col("paths")))
    assert all(r["got"] == r["want"] for r in df.collect())
    assert rules.expected_setting("switch", "diverging-toe") == "diverging" and rules.degree("dkw") == 4


def test_word_error_rate(spark, sf):
    from semaphora.plans.dataset import _turns

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rows = [([w for w in r["truth"].split(" ") if w], [w for w in r["predicted"].split(" ") if w]) for r in _turns(spark, sf).collect()]
    got = all_queries()["label_wer"](spark, sf).first()
    assert (got["edits"], got["words"]) == (sum(distance(a, b) for a, b in rows), sum(len(a) for a, _ in rows))


def test_consensus_draft_has_majorities(spark, sf):
    from semaphora.plans import review

    v = review.votes(spark, sf).drop("cluster_no", "member_pos")
    v = v.join(review.matching.clusters(v, review.DIAGONAL), ["doc", "model_no", "id"])
    groups = {}
    for r in v.select("doc", "cluster_no", "model_no", "kind", "label").collect():
        groups.setdefault((r["doc"], r["cluster_no"]), []).append(r)

    def most(rows, name):
        values = [r[name] for r in sorted(rows, key=lambda r: r["model_no"])]
        return max(dict.fromkeys(values), key=values.count)

    rows = review.consensus_draft(spark, sf).collect()
    key = lambda doc, kind, label: (doc, str(kind), str(label))
    assert rows and sorted(key(r["doc"], r["kind"], r["label"]) for r in rows) == sorted(key(d, most(g, "kind"), most(g, "label")) for (d, _), g in groups.items())


def test_metrics_over_matches(spark, sf):
    from semaphora.operators import metrics

    matched = spark.createDataFrame([(1, "nodes", "a", "p1"), (1, "nodes", "b", "p2"), (2, "nodes", "a", "p3"), (1, "edges", "e", "a")], "doc long, family string, t_id string, p_id string")
    truth = spark.createDataFrame([(1, "a", "A", "b", "B"), (2, "a", "A", "c", "B")], "doc long, a_node string, a_port string, b_node string, b_port string")
    found = spark.createDataFrame([(1, "p2", "B", "p1", "A"), (1, "p1", "A", "p3", "B"), (2, "p3", "A", "c", "B"), (2, None, "A", "p3", "A")], truth.schema)
    rows = metrics.in_truth_ids(found, matched, {"a_node": "nodes", "b_node": "nodes"})
    assert {tuple(r[c] for c in found.columns) for r in rows.collect()} == {(1, "b", "B", "a", "A"), (1, "a", "A", "?p3", "B"), (2, "a", "A", "?c", "B"), (2, None, "A", "a", "A")}
    # in scene 1 one of two edges is right, in scene 2 none of three: an unmatched id never is, even one that looks like the truth's
    assert {r["doc"]: r["jaccard"] for r in metrics.topology_agreement(truth, rows).collect()} == {1: 0.5, 2: 0.0}
    pairs = all_queries()["match_elements"](spark, sf).count()
    nodes = next(r for r in all_queries()["detection_matched"](spark, sf).collect() if r["family"] == "nodes")
    assert nodes["tp"] == pairs and nodes["fp"] > 0 and nodes["fn"] > 0


def test_large_documents_cost_what_their_elements_cost(spark):
    """A document of 1,000 inner nodes: issues of all look-ups are right, and it doesn't take the cube of its size."""
    from semaphora.operators.generate import generated
    from semaphora.sources.shared import written

    kinds = F.array(*map(F.lit, ("switch", "ekw", "joint")))
    rows = spark.range(2).select(F.col("id").alias("doc"), F.lit(1000).alias("n"))
    rows = written(generated(rows, "n", lambda i: F.get(kinds, F.pmod(F.col("doc") + i, F.lit(3)).cast("int"))), "large")
    assert validator.exploded(validator.validate(rows)).count() == 0
    edges = F.col("scene.topology.edges")
    twice = F.array_append(edges, F.get(edges, F.lit(3)))  # an edge again: its id, and the ports of both its ends
    bad = written(rows.select("doc", F.col("scene").withField("topology.edges", twice).alias("scene")), "large")
    began = time.time()
    found = validator.exploded(validator.validate(bad)).groupBy("doc", "code").count().collect()
    assert time.time() - began < 100
    assert sorted((r["doc"], r["code"], r["count"]) for r in found) == [(d, c, n) for d in (0, 1) for c, n in (("ID_DUPLICATE", 1), ("TOPO_DEGREE", 2), ("TOPO_PORT_DUP", 2))]


def test_families_are_matched_apart(spark):
    """Equal positions in two families don't meet in one matrix."""
    rows = [(1, f, t, p, f"{f}{t}", f"{f}{p}", 0.1 if t == p else 0.5) for f, n in (("nodes", 3), ("signals", 2)) for t in range(n) for p in range(n)]
    pairs = spark.createDataFrame(rows, "doc long, family string, t_idx int, p_idx int, t_id string, p_id string, cost double")
    got = sorted((r["family"], r["t_id"], r["p_id"]) for r in matching.matches(pairs).collect())
    assert got == [(f, f"{f}{i}", f"{f}{i}") for f, n in (("nodes", 3), ("signals", 2)) for i in range(n)]


def test_word_errors_of_very_many_words(spark, monkeypatch):
    """More distinct words than there are characters below the surrogates, and words beyond ASCII."""
    from semaphora.plans import dataset

    many = " ".join(f"w{i}" for i in range(36_000))
    rows = [("w0 wörd w3", "w0 word w3"), (many, "w35999 w1"), ("", "a b"), ("ß é", "é")]
    turns = spark.createDataFrame(rows, "truth string, predicted string")
    monkeypatch.setattr(dataset, "_turns", lambda spark, sf: turns)
    assert tuple(dataset.label_wer(spark, "").first()) == (1 + 35_999 + 2 + 1, 3 + 36_000 + 0 + 2)
