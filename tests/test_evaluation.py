"""Metrics of models over matches against the same told plainly, scene by scene; the folder of a run."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from semaphora.operators import evaluation, matching, merge
from semaphora.plans.review import DIAGONAL, models
from semaphora.sources import runs
from semaphora.sources.shared import written

from .test_merge import FAR, PLACES, apart, edits, listed, place

NAMES = {"nodes": "switches", "edges": "tracks", "signals": "signals", "derailers": "derailers", "routes": "routes"}


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = models(spark, sf).filter(F.pmod("doc", F.lit(50)) == 1)
    return written(rows.unionByName(rows.filter("model_no = 0").withColumn("model_no", F.lit(7)).withColumn("doc", -F.col("doc"))), "some-models")  # some without a truth


@pytest.fixture(scope="module")
def told(docs):
    """(doc, model_no) -> scene as nested dicts."""
    return {(r["doc"], r["model_no"]): r["scene"].asDict(True) for r in docs.collect()}


def cost(family, a, b):
    far = 1.0 if family == "routes" else apart(a["geometry"], b["geometry"])
    if family != "routes" and place(a["geometry"]) and place(b["geometry"]) and far >= 1:
        return FAR
    strip = lambda x: x if x is None else x.strip()
    return 0.5 * edits(strip(a["label"]), strip(b["label"])) + 0.3 * (a.get("kind") != b.get("kind")) + 0.2 * far


@pytest.fixture(scope="module")
def pairs(docs):
    t = merge.elements(docs.filter("model_no = 1"))
    return written(evaluation.costs(t, merge.elements(docs.filter("model_no <> 1")), evaluation.diagonals(docs.filter("model_no = 1"))), "some-costs")


def test_costs_of_all_families(told, pairs):
    got = {(r["doc"], r["model_no"], r["family"], r["t_idx"], r["p_idx"]): r["cost"] for r in pairs.collect()}
    want = {}
    for (doc, m), scene in told.items():
        if m == 1 or doc < 0:
            continue
        for family in PLACES:
            for i, a in enumerate(listed(told[doc, 1], family) or ()):
                for j, b in enumerate(listed(scene, family) or ()):
                    want[doc, m, family, i, j] = cost(family, a, b)
    assert {k[2] for k in want} == set(PLACES) and got.keys() == want.keys()
    wrong = {k: (got[k], v) for k, v in want.items() if not math.isclose(got[k], v, abs_tol=1e-9)}
    assert not wrong, (len(wrong), len(want), list(wrong.items())[:8])


def rates_of(told, matched):
    """metric -> part -> [hits, of] of each (doc, model)."""
    out = defaultdict(lambda: [0, 0])

    def add(job, metric, part, hits, of):
        out[(*job, metric, part)][0] += hits
        out[(*job, metric, part)][1] += of

    def found(job, name, part, both, t, p):
        for metric, hits, of in (("precision", both, p), ("recall", both, t), ("f1", 2 * both, t + p)):
            add(job, f"{name}_{metric}", part, hits, of)

    def word_edits(a, b):
        code = {w: chr(0x100 + k) for k, w in enumerate(dict.fromkeys(a + b))}
        return round(edits("".join(map(code.get, a)), "".join(map(code.get, b))) * max(len(a), len(b), 1))

    for job, scene in told.items():
        doc, m = job
        if m == 1 or doc < 0:
            continue
        truth, pairs = told[doc, 1], matched[job]
        for family in PLACES:
            t, p = listed(truth, family) or [], listed(scene, family) or []
            mine = [(i, j) for f, i, j in pairs if f == family]
            if t or p:
                found(job, "detection", family, len(mine), len(t), len(p))
            for i, j in mine:
                a, b = t[i]["label"], p[j]["label"] or ""
                if a is not None:
                    add(job, "label_cer", family, round(edits(a, b) * max(len(a), len(b), 1)), len(a))
                    add(job, "label_wer", family, word_edits(a.split(" "), b.split(" ") if b else []), len(a.split(" ")))
                x, y = (s["state"][NAMES[family]].get(e["id"]) or {} for s, e in ((truth, t[i]), (scene, p[j])))
                for name in evaluation.STATE_FIELDS[family]:
                    tell = lambda s: s.get(name) if name != "active_paths" or s.get(name) is None else {frozenset(q) for q in s[name]}  # noqa: B023, E731
                    if tell(x) is not None:
                        add(job, "state_accuracy", f"{NAMES[family]}/{name}", tell(x) == tell(y) != "unknown", 1)
        meant = {f"{f}/{(listed(scene, f))[j]['id']}": f"{f}/{i}" for f, i, j in pairs}
        own = {f"{f}/{e['id']}": f"{f}/{i}" for f in PLACES for i, e in enumerate(listed(truth, f) or ())}

        def keys(s, known, lost):
            at = lambda i, *fs: next((known[f"{f}/{i}"] for f in fs if f"{f}/{i}" in known), f"{lost}{i}")
            routes = Counter((at(r["start"], "signals"), at(r["end"], "signals", "nodes"), *(at(e, "edges") for e in r["path"])) for r in s["routes"])
            edges = {frozenset((at(e[x]["node"], "nodes"), e[x]["port"]) for x in "ab") for e in s["topology"]["edges"]}
            ends = Counter(e[x]["node"] for e in s["topology"]["edges"] for x in "ab")
            return routes, edges, Counter(ends[n["id"]] for n in s["topology"]["nodes"])

        (tr, te, td), (pr, pe, pd) = keys(truth, own, "!"), keys(scene, meant, "?")
        if tr or pr:
            found(job, "route", "all", (tr & pr).total(), tr.total(), pr.total())
        if te or pe:
            add(job, "topology_jaccard", "all", len(te & pe), len(te | pe))
        add(job, "degree_similarity", "all", (td & pd).total(), (td | pd).total())
    return {k: tuple(v) for k, v in out.items()}


def test_tallies_are_those_of_plain_scenes(docs, told, pairs):
    matched = defaultdict(list)
    for r in matching.matches(pairs).collect():
        matched[r["doc"], r["model_no"]].append((r["family"], r["t_idx"], r["p_idx"]))
    rows = evaluation.tallies(docs.filter("model_no = 1").select("doc", "scene"), docs.filter("model_no <> 1"))
    got = {(r["doc"], r["model_no"], r["metric"], r["part"]): (r["hits"], r["of"]) for r in rows.collect()}
    want = rates_of(told, matched)
    assert {k[2] for k in want} >= {"detection_f1", "label_cer", "label_wer", "state_accuracy", "route_f1", "topology_jaccard", "degree_similarity"}
    assert got == want


def test_a_renamed_truth_is_found_whole(spark, docs):
    """The same document under other ids: all that is known is right."""
    t = docs.filter("model_no = 1 and doc > 0").limit(8)
    t = written(t, "few")
    same = evaluation.tallies(t.select("doc", "scene"), t.withColumn("model_no", F.lit(3)))
    values = {(r["metric"], r["part"]): r["value"] for r in evaluation.rates(same, ["model_no"]).collect()}
    assert values.pop(("label_cer", "all")) == 0 and values.pop(("label_wer", "all")) == 0
    for (metric, part), v in values.items():  # edges of nodes that are missing on both sides equal nothing
        if metric.startswith(("detection", "degree")):
            assert v == 1, (metric, part, v)
    assert 0 < values["topology_jaccard", "all"] < 1
    none = evaluation.tallies(t.select("doc", "scene").limit(0), t)
    assert none.count() == 0 and evaluation.rates(none, ["model_no"]).count() == 0


def test_folders_of_runs_and_splits(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert runs.run_path("/r/", "one") == "/r/one" and runs.run_path("/r", "one", "metrics") == "/r/one/metrics.parquet"
    assert runs.split_path("/d", "dev", "manifest") == "/d/gt/dev/manifest.jsonl" and runs.split_path("/d", "dev", "truth", "s1") == "/d/gt/dev/s1.json" and runs.split_path("/d", "dev", "work") == "/d/review/dev/work"
    for name in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            runs.run_path("/r", name)
    with pytest.raises(ValueError):
        runs.split_path("/d", "dev", "truth")
    assert runs.read_predictions(spark, root, "r").count() == 0 and runs.read_metrics(spark, root, "r").count() == 0
    row = lambda scene, attempt, latency, doc, cost: (scene, "r", "m", "single_shot", attempt, latency, 10, None, cost, "", doc, None, None)
    log = lambda rows: spark.createDataFrame(rows, runs.files.PREDICTIONS)
    runs.append_predictions(log([row("a", 1, 10.0, None, 0.5), row("b", 1, 20.0, "{}", None)]), root, "r")
    runs.append_predictions(log([row("a", 2, 40.0, "{}", 0.25), row("c", 1, 30.0, None, 1.0)]), root, "r")
    read = runs.read_predictions(spark, root, "r")
    assert read.count() == 4 and {(r["scene_id"], r["attempt"]) for r in runs.last_attempts(read).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    names = spark.createDataFrame([(1, 0, "a", "m", "single_shot")], "doc long, model_no int, scene_id string, model string, mode string")
    tallies = spark.createDataFrame([(1, 0, "label_cer", "nodes", 1, 4), (1, 0, "label_cer", "edges", 0, 0), (9, 0, "label_cer", "nodes", 1, 1)], "doc long, model_no int, metric string, part string, hits long, of long")
    rows = runs.log_metrics(read).unionByName(runs.tally_metrics(tallies, names))
    for _ in range(2):  # written again, it is the same
        runs.write_metrics(rows, root, "r")
        runs.write_summary(runs.summary(runs.read_metrics(spark, root, "r")), root, "r")
    assert runs.read_metrics(spark, root, "r").count() == rows.count() == 3 + 3 + 2 + 3 + 2
    out = {(r["metric"], r["part"]): r for r in spark.read.json(runs.run_path(root, "r", "summary")).collect()}
    assert {k: r["value"] for k, r in out.items()} == {("success", "all"): 0.666666667, ("latency_ms", "all"): 30.0, ("cost_usd", "all"): 0.875, ("tokens_in", "all"): 13.333333333, ("label_cer", "nodes"): 0.25}
    assert out["latency_ms", "all"]["p95"] == 39.0 and out["tokens_in", "all"]["total"] == 40 and out["cost_usd", "all"]["scenes"] == 2
