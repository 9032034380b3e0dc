"""What keeps queries in bounds on larger tables: what is made once, and what plans look like."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaphora.operators import consensus, matching, metrics, review, validator
from semaphora.operators import documents as D
from semaphora.operators.generate import generated
from semaphora.plans.board import adopt_suggestions, degree_sequences, review_worklist
from semaphora.plans.review import QUERIES, consensus_draft, edge_pair_costs, nearest_edge, votes
from semaphora.plans.validation import QUERIES as QUERIES_VALIDATION
from semaphora.sources import bridge


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Orders of more than two periods of shapes, and one without a key."""
    folder = str(tmp_path_factory.mktemp("many"))
    keys = spark.range(2 * bridge.PERIOD + 100).union(spark.range(10**9, 10**9 + 50)).union(spark.sql("SELECT CAST(NULL AS bigint) AS id"))
    keys.select(F.col("id").alias("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_scenes_come_from_a_bounded_table_of_shapes(spark, many):
    assert bridge._shapes(spark, many, True).count() == bridge.PERIOD + 1
    made = bridge.scenes(spark, many)
    kinds = F.array(*map(F.lit, ("joint", "switch", "dkw", "ekw", "crossing")))
    kind = lambda i: F.get(kinds, F.pmod(bridge._h() * 7 + i * 3, F.lit(5)).cast("int"))
    some = spark.read.parquet(f"{many}/orders.parquet").select(F.col("o_orderkey").alias("doc")).filter("doc is null or doc >= 4700")
    direct = bridge.faulty(generated(some, F.pmod(F.floor(F.col("doc") / 20), F.lit(4)), kind, derailer=F.pmod(bridge._h(), F.lit(3)) == 0))
    text = lambda rows: {r.doc: r.s for r in rows.select("doc", F.to_json("scene").alias("s")).collect()}
    got, want = text(made), text(direct)
    assert len(got) == 2 * bridge.PERIOD + 151
    assert all(got[doc] == s for doc, s in want.items())


def _broadcasts(df):
    """Joins of the plan that broadcast something other than the shapes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "shape#" not in line]


@pytest.mark.parametrize("query", [edge_pair_costs, nearest_edge, degree_sequences])
def test_elements_are_not_broadcast(spark, sf, query):
    """Files of scenes are small for what they hold, so a plan that goes by their size broadcasts what the driver can't hold."""
    assert _broadcasts(query(spark, sf)) == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draft_clusters_once_and_shuffles_votes_once(spark, sf):
    """Scenes are dealt out by doc before anything is taken from them; behind the kernel votes move once, with all they need."""
    plan = _plan(consensus_draft(spark, sf))
    assert plan.count("MapInArrow") == 1
    assert plan.count("Exchange hashpartitioning") == 4  # keys for the elements and for both sides of the pairs, then the votes


def test_pairs_too_far_apart_are_left_out(spark):
    rows = [(1, m, i, f"{m}{i}", "a", "k", 300.0 * i + m, 0.0) for m in range(2) for i in range(3)]
    e = spark.createDataFrame(rows, "doc long, model_no int, idx int, id string, label string, kind string, x double, y double")
    assert matching.between(e, 894.0).count() == 3
    got = {(r.model_no, r.id, r.cluster_no, r.label) for r in matching.clusters(e, 894.0, matching.THRESHOLD, "label").collect()}
    assert got == {(m, f"{m}{i}", i, "a") for m in range(2) for i in range(3)}


def test_assignment_is_the_least_of_all():
    rng = np.random.default_rng(7)
    settled = 0
    for k in range(400):
        cost = np.round(rng.random(rng.integers(1, 5, 2)) * 1.2, 1 + k % 4)
        cost[cost > 0.5 + k % 2] = 1e6
        flip = cost.T if cost.shape[0] > cost.shape[1] else cost
        settled += matching._settled(flip, 0.6) is not None
        total = lambda own: sum(flip[a, b] for a, b in enumerate(own))
        least = min(map(total, itertools.permutations(range(flip.shape[1]), flip.shape[0])))
        full = matching.assign(cost, np.inf)
        assert len(full) == len(flip) and abs(sum(cost[p] for p in full) - least) < 1e-6
        assert all(cost[p] <= 0.6 for p in matching.assign(cost))
    assert settled > 100


def test_shape_check_takes_each_field_once(spark):
    """No object is written out as text for its keys, and no list or object has its whole schema derived."""
    rows = spark.createDataFrame([(1, '{"schema_version":"v0","more":1}'), (2, "[1]"), (3, None)], "doc long, body string").select("doc", D.shape_problems(F.col("body")).alias("p"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "json_object_keys" not in plan
    assert {r.doc: r.p for r in rows.collect()} == {1: [""], 2: [""], 3: [""]}


def test_two_sides_are_grouped_not_joined(spark, sf):
    plans = [_plan(f(spark, sf)) for f in (QUERIES["detection_prf1"], QUERIES["topology_jaccard"])]
    assert not any("FullOuter" in p for p in plans)
    row = "doc long, family string, id string"
    t = spark.createDataFrame([(1, "f", "a"), (1, "f", "a"), (1, "f", None)], row)
    p = spark.createDataFrame([(1, "f", "a"), (1, "f", None), (2, "f", "b")], row)
    assert {(r.family, r.tp, r.fp, r.fn) for r in metrics.detection(t, p).collect()} == {("f", 1, 2, 1), (None, 1, 2, 1)}


def test_references_are_followed_within_their_document(spark, sf):
    """No step of the closure moves elements by (doc, id)."""
    assert not re.search(r"hashpartitioning\(doc#\d+L?, (id|ref)#", _plan(QUERIES["suggestions"](spark, sf)))


def test_rules_put_paths_together_for_issues_only():
    assert "topology/edges/" not in str(validator._end(F.col("e"), F.col("i"), "a"))


def test_generated_scenes_are_made_once_for_each_shape(spark, sf):
    plan = _plan(QUERIES_VALIDATION["generate_scene"](spark, sf))
    assert "n_w" not in plan and "SortMergeJoin" not in plan  # neither the generator nor a second making of the scenes


def test_ports_are_looked_up_by_hash(spark, sf):
    plan = QUERIES_VALIDATION["rule3_ports"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "boundary|A, " not in plan.split("INSET")[0]


def test_review_groups_draft_and_final_without_a_join(spark, sf):
    for name in ("review_summary", "provenance_diff"):
        plan = _plan(QUERIES[name](spark, sf))
        assert "SortMergeJoin" not in plan and "ENSURE_REQUIREMENTS" not in plan
    rows = [
        (1, "a", "x", "draft", False), (1, "a", "y", "draft", True), (1, "e", None, "draft", True), (1, None, "x", "draft", True), (2, "a", "x", "draft", True), (None, "a", "x", "draft", True),
        (1, "b", "z", "suggested", False), (1, "b2", "z", "suggested", False), (1, "f", None, "suggested", False),
        (1, "a", "x", "final", False), (1, "b", "z", "final", True), (1, "b", "z", "final", True), (1, "b2", "q", "final", False), (1, "c", "x", "final", True), (1, None, "x", "final", True), (1, "f", None, "final", False), (None, "a", "x", "final", True),
    ]
    made = spark.createDataFrame(rows, "doc long, id string, content string, side string, checked boolean")
    made = made.select("doc", "id", "content", *(F.col("side").eqNullSafe(s).alias(s) for s in ("draft", "suggested", "final")), "checked")
    got = {r.doc: tuple(r)[1:] for r in consensus.review_summary(made).collect()}
    # draft, final, prefill_accepted, human_edited, suggestion_accepted, human_added, deleted, checked
    assert got == {1: (4, 8, 1, 2, 3, 2, 2, 3, 0.5), 2: (1, 0, 0, 0, 0, 0, 1, 0, 0.0), None: (0, 1, 0, 0, 0, 1, 0, 0, 1.0)}
    origins = sorted((str(r.doc), str(r.id), r.origin) for r in consensus.provenance(made).collect())
    assert origins == [
        ("1", "None", "human_added"), ("1", "a", "human_edited"), ("1", "a", "prefill_accepted"), ("1", "b", "suggestion_accepted"), ("1", "b", "suggestion_accepted"), ("1", "b2", "human_edited"),
        ("1", "c", "human_added"), ("1", "f", "suggestion_accepted"), ("None", "a", "human_added"),
    ]


def test_match_by_near_pairs_is_the_same_as_by_all(spark):
    """Rivals for an element, elements without a place, far ones, scenes of one side only, gaps in idx, families."""
    rng = np.random.default_rng(5)
    place = lambda: None if rng.random() < 0.15 else float(rng.integers(0, 120))
    rows = []
    for doc in range(120):
        for m in range(2):
            for i in range(0 if doc % 17 == m else int(rng.integers(0, 7))):
                x = place()
                rows.append((doc if doc % 3 else doc + 2**40, m, "fg"[i % 2], 3 * i, f"{m}-{i}", f"{'LM'[int(rng.integers(2))]}{i}", "ab"[int(rng.integers(2))], x, None if x is None else float(rng.integers(0, 90)) + rng.random()))
    e = spark.createDataFrame(rows, "doc long, model_no int, family string, idx int, id string, label string, kind string, x double, y double")
    text = lambda df: sorted(map(str, df.collect()))
    for elements in (e, e.drop("family")):
        t, p = elements.filter("model_no = 0"), elements.filter("model_no = 1")
        every = matching.costs(t, p, 894.0)
        want = text(matching.matches(every))
        assert want and text(matching.matched(t, p, 894.0)) == want
        near = matching.costs(t, p, 894.0, far=False)
        assert text(near) == text(every.filter(F.col("cost") < matching.FAR)) and near.count() < every.count()
    with pytest.raises(ValueError):
        matching.matched(e, e, 894.0, matching.FAR)


def test_references_are_translated_without_a_join(spark, sf):
    plan = _plan(QUERIES["translate_refs"](spark, sf))
    assert "SortMergeJoin" not in plan and "ENSURE_REQUIREMENTS" not in plan
    v = votes(spark, sf)
    got = consensus.members(v, "nodes").select("doc", "model_no", "id", "draft_id")
    want = v.join(consensus.draft_ids(v, "nodes"), ["doc", "cluster_no"]).select("doc", "model_no", "id", "draft_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    refs = spark.createDataFrame([(1, 0, "m", "a"), (1, 0, "m", "a"), (1, 0, None, "b"), (1, 1, "m", "a"), (1, 0, "m", None), (None, 0, "m", "a")], "doc long, model_no int, id string, ref string")
    ids = spark.createDataFrame([(1, 0, "a", "n001"), (1, 0, "b", "n002"), (1, 0, "b", "n003"), (1, 0, "z", "n004"), (1, 0, None, "n005"), (None, 0, "a", "n006")], "doc long, model_no int, id string, draft_id string")
    got = sorted(map(str, (tuple(r) for r in consensus.translated(refs, ids).collect())))
    assert got == sorted(map(str, [(1, 0, "m", "n001"), (1, 0, "m", "n001"), (1, 0, None, "n002"), (1, 0, None, "n003"), (1, 1, "m", "a"), (1, 0, "m", None), (None, 0, "m", "a")]))


def test_worklist_moves_nothing_by_id(spark, sf):
    plan = _plan(review_worklist(spark, sf))
    assert "SortMergeJoin" not in plan and "ENSURE_REQUIREMENTS" not in plan


def test_suggestions_are_adopted_within_their_document(spark, sf):
    """No table of chosen or open elements is broadcast or joined: the driver would hold it."""
    plan = _plan(adopt_suggestions(spark, sf))
    assert _broadcasts(adopt_suggestions(spark, sf)) == []
    assert "SortMergeJoin" not in plan and "ENSURE_REQUIREMENTS" not in plan
    of = lambda rows, t: spark.createDataFrame(rows, t)
    links = of([(1, "s", "e"), (1, "e", "n"), (1, "x", "n"), (2, "s", "e"), (None, "s", "e")], "doc long, id string, ref string")
    open_ = of([(1, "s"), (1, "e"), (1, "n"), (1, "y"), (2, "s"), (None, "s")], "doc long, id string")
    got = review.adopted(of([(1, "s"), (1, "s"), (1, "y"), (1, "gone"), (2, "s"), (None, "s")], "doc long, id string"), open_, links, of([(1, "y"), (3, "s")], "doc long, id string"))
    assert sorted(map(tuple, got.collect())) == [(1, "s", "e", 2), (1, "s", "n", 1), (1, "s", "s", 3), (2, "s", "s", 1)]


def test_repeated_orders_adopt_once(spark, tmp_path):
    spark.range(40).union(spark.range(20)).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    rows = adopt_suggestions(spark, str(tmp_path))
    assert rows.count() == rows.distinct().count() > 0
