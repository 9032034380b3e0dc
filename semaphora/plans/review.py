"""Queries of matching, consensus, review and metrics over scenes and their faultless twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus, all_ids
from ..functions import geometry as G
from ..functions import scenes as S
from ..operators import consensus, matching, merge, metrics
from ..scene import GEOMETRY, field
from ..sources.bridge import corpus, prelude, scenes
from ..sources.shared import written

DIAGONAL = 894.427190999916  # of 800 x 400

#: Three models' views of each scene's nodes: shifted, renamed, dropped here and there. Shared text.
_VOTES = """SELECT doc, m AS model_no, idx, id, CASE WHEN (doc + 2 * idx + m) % 5 = 0 THEN concat('M', id) ELSE concat('L', id) END AS label, CASE WHEN (doc + idx + m) % 11 = 0 THEN 'joint' ELSE kind END AS kind,
  CAST((idx * 97 + doc % 13 * 10) % 800 + (doc * m + idx) % 9 AS double) AS x, CAST((idx * 41 + doc % 7 * 30) % 400 + (doc + m * idx) % 5 AS double) AS y, idx AS cluster_no, m AS member_pos
  FROM node CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(m)) AS models WHERE (doc + idx + m) % 7 <> 0"""


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_VOTES.replace("FROM node", "FROM {node}"), node=corpus(spark, sf, False).node)


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    v = votes(spark, sf)
    return matching.costs(v.filter("model_no = 0"), v.filter("model_no = 1"), DIAGONAL)


def _assigned(spark: SparkSession, sf: str, a: int, b: int) -> DataFrame:
    v = votes(spark, sf)
    return matching.matched(v.filter(F.col("model_no") == a), v.filter(F.col("model_no") == b), DIAGONAL).drop("t_idx", "p_idx")


def _both(spark: SparkSession, sf: str) -> tuple[Corpus, Corpus]:
    return corpus(spark, sf, False), corpus(spark, sf)


def _states(c: Corpus) -> DataFrame:
    parts = [t.select("doc", F.lit(f).alias("family"), "id", v.alias("value")) for f, t, v in (("signals", c.state_signal, F.col("value")), ("tracks", c.state_track, F.col("value")), ("switches", c.state_switch, F.concat_ws("/", "position", "paths")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _routes(c: Corpus) -> DataFrame:
    path = c.route_path.groupBy("doc", F.col("route_idx").alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edge_id"))), lambda x: x["edge_id"]), ">").alias("path"))
    return c.route.join(path, ["doc", "idx"]).select("doc", "id", "start", "end_id", "path")


def _elements(c: Corpus) -> DataFrame:
    """Elements with what counts of them, as one value."""
    n = c.node.select("doc", "id", F.concat_ws("|", "kind", "n_half").alias("content"))
    e = c.edge.select("doc", "id", F.concat_ws("|", "kind", "a_node", "a_port", "b_node", "b_port").alias("content"))
    s = c.signal.filter("id <> 'n_w'").select("doc", "id", F.concat_ws("|", "kind", "at_edge", "at_dir").alias("content"))
    return n.unionByName(e).unionByName(s)


def _review(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of the draft (those whose ids begin with s as suggestions) and of the final scenes, some ticked off."""
    final, draft = _both(spark, sf)
    ticked = (F.col("doc") + F.length("id")) % 4 != 1
    d = consensus.marked(_elements(draft), "draft", ticked)
    suggested = F.col("id").startswith("s")
    return d.withColumns({"draft": ~suggested, "suggested": suggested}).unionByName(consensus.marked(_elements(final), "final", ticked))


def provenance_diff(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.provenance(_review(spark, sf))


def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.review_summary(_review(spark, sf))


def human_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = review_summary(spark, sf).agg(F.sum("human_edited").alias("edited"), F.sum("human_added").alias("added"), F.sum("final_elements").alias("final"))
    return rows.select("edited", "added", "final", F.round((F.col("edited") + F.col("added")) / F.col("final"), 9).alias("human_share"))


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Elements with their support, and references: edges to nodes, signals to edges."""
    c = corpus(spark, sf)
    has = lambda t: t.select("doc", "id", F.pmod(F.col("doc") + F.col("idx"), F.lit(3)).alias("support"))
    elements = has(c.node).unionByName(has(c.edge)).unionByName(has(c.signal.filter("id <> 'n_w'")))
    refs = c.edge.select("doc", "id", F.explode(F.array("a_node", "b_node")).alias("ref")).unionByName(c.signal.filter("id <> 'n_w'").select("doc", "id", F.col("at_edge").alias("ref")))
    return elements, refs


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    """What _graph() gives, a row for each document: e (id, whether its support is at least 2) and r (id, ref)."""
    scene = F.col("scene")
    one = scenes(spark, sf, once=True)
    has = lambda x, i: F.struct(x["id"].alias("id"), (F.pmod(F.col("doc") + i, F.lit(3)) >= 2).alias("enough"))
    link = lambda x, ref: F.struct(x["id"].alias("id"), ref.alias("ref"))
    own = lambda items: F.filter(items, lambda x: x["id"] != "n_w")
    nodes, edges, signals = (field(scene, path) for path in ("topology/nodes", "topology/edges", "signals"))
    ends = F.flatten(F.transform(edges, lambda x: F.array(link(x, x["a"]["node"]), link(x, x["b"]["node"]))))
    e = F.concat(F.transform(nodes, has), F.transform(edges, has), own(F.transform(signals, has)))
    return one.select("doc", e.alias("e"), F.concat(ends, F.transform(own(signals), lambda x: link(x, x["at"]["edge"]))).alias("r"))


def draft_closure(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.closure(*_graph(spark, sf), 2)


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    elements, refs = _graph(spark, sf)
    return consensus.suggestions(elements, refs, consensus.closure(elements, refs, 2))


def translate_refs(spark: SparkSession, sf: str) -> DataFrame:
    ids = consensus.members(votes(spark, sf), "nodes").filter("model_no = 1")
    refs = corpus(spark, sf, False).edge.select("doc", "id", F.explode(F.array("a_node", "b_node")).alias("ref")).withColumn("model_no", F.lit(1))
    return consensus.translated(refs, ids)


def consensus_draft(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of nodes across models, merged: kind and label by majority (of ties the first model's), place by median,
    support, status and draft id."""
    v = matching.clusters(votes(spark, sf), DIAGONAL, matching.THRESHOLD, "label", "kind", "x", "y")
    return consensus.drafts(v, "nodes", ["label", "kind"], 3).select("doc", "draft_id", "kind", "label", "support", "status", "disagree", "x", "y")


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Three models' documents of each scene: (doc, model_no, scene). Elements are renamed, moved, mistaken and dropped
    here and there; every family has places of its own kind, and some elements have none."""
    doc, m, scene = F.col("doc"), F.col("model_no"), F.col("scene")
    own = lambda id_: F.concat(id_, F.lit("_"), m.cast("string"))
    every = lambda i, n: F.pmod(doc + i + m, F.lit(n)) == 0
    shifted = lambda i, by, most: F.pmod(i * by, F.lit(most)).cast("double") + F.pmod(doc * m + i, F.lit(5))
    shape = lambda **g: F.struct(*(g.get(n, F.lit(None)).alias(n) for n in ("bbox", "polyline", "point"))).cast(GEOMETRY)

    def node(e, i):
        return e.withField("geometry", shape(point=F.array(shifted(i, 97, 800), shifted(i, 41, 400)))).withField("kind", F.when(every(i, 11), "joint").otherwise(e["kind"])).withField("label", F.concat(F.when(every(2 * i, 5), "M").otherwise("L"), e["id"]))

    def edge(e, i):
        x, y = shifted(i, 89, 700), shifted(i, 53, 300)
        line = shape(polyline=F.array(F.array(x, y), F.array(x + 30, y), F.array(x + 60, y + 30)))
        return e.withField("geometry", F.when(F.pmod(doc + i, F.lit(10)) != 0, line)).withField("kind", F.when(every(i, 6), "siding").otherwise(e["kind"])).withField("a", e["a"].withField("node", own(e["a"]["node"]))).withField("b", e["b"].withField("node", own(e["b"]["node"])))

    def placed(e, i):
        x, y = shifted(i, 211, 700), shifted(i, 67, 300)
        found = F.when(every(i, 3), shape(bbox=F.array(x - 4, y - 2, x + 4, y + 2))).when(~every(i, 4), shape(point=F.array(x, y)))
        return e.withField("geometry", found).withField("at", F.struct(own(e["at"]["edge"]).alias("edge"), (m / 7 + 0.1).alias("offset"), e["at"]["direction"].alias("direction"))).withField("label", F.when(~every(i, 6), F.concat(F.lit("S"), i.cast("string"))))

    def route(e, i):
        return e.withField("start", own(e["start"])).withField("end", own(e["end"])).withField("path", F.transform(e["path"], own)).withField("label", F.when(every(i, 2), e["id"]))

    def those(path, change, n):
        value = scene
        for name in path.split("."):
            value = value[name]
        return F.array_compact(F.transform(value, lambda e, i: F.when(~every(3 * i, n), change(e, i).withField("id", own(e["id"])))))

    routes = those("routes", route, 9)
    twice = F.concat(routes, F.transform(routes, lambda e: e.withField("id", F.concat(e["id"], F.lit("b")))))
    states = {name: F.transform_keys(scene["state"][name], lambda k, _: own(k)) for name in ("switches", "signals", "tracks", "derailers", "routes")}
    occupied = lambda k, v: F.when(F.pmod(doc + m + F.length(k), F.lit(4)) == 0, v.withField("occupancy", F.lit("occupied"))).otherwise(v)
    states["tracks"] = F.transform_values(states["tracks"], occupied)
    parts = {  # whole structs: a changed field inside a struct would double the plan each time
        "topology": F.struct(those("topology.nodes", node, 7).alias("nodes"), those("topology.edges", edge, 9).alias("edges")), "signals": those("signals", placed, 8), "derailers": those("derailers", placed, 5),
        "routes": F.when(F.pmod(doc + m, F.lit(5)) == 0, twice).otherwise(routes), "state": F.struct(*(c.alias(name) for name, c in states.items()), scene["state"]["observed_at_ms"].alias("observed_at_ms")),
    }
    new = F.struct(*(parts.get(name, scene[name]).alias(name) for name in ("schema_version", "scene_id", "source", "provenance", "topology", "signals", "derailers", "routes", "state", "meta")))
    rows = scenes(spark, sf, False).withColumn("model_no", F.explode(F.array(*map(F.lit, range(3)))))
    return rows.select("doc", "model_no", new.alias("scene"))


def merged_draft(spark: SparkSession, sf: str) -> DataFrame:
    rows = merge.merged(written(models(spark, sf), "models"), DIAGONAL)
    return rows.drop("line").withColumns({c: F.array_join(c, ",") for c in ("refs", "disagree")})


def state_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Merged states of elements that are in the draft."""
    return merge.merged(written(models(spark, sf), "models"), DIAGONAL).filter("state is not null and chosen").select("doc", "family", "id", "state")


def route_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of routes by exact key."""
    rows = written(merge.elements(models(spark, sf)), "elements")
    return merge.members(rows, DIAGONAL).filter("family = 'routes'").select("doc", "model_no", "id", "cluster_no", "member_pos", "draft_id")


def edge_pair_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a scene's edges in two versions, by how many end nodes they share; no geometry counts as far apart."""
    truth, pred = _both(spark, sf)
    ends = lambda c, x: c.edge.select("doc", F.col("id").alias(x), F.array_distinct(F.array("a_node", "b_node")).alias(f"{x}_ends"))
    rows = ends(truth, "t").join(ends(pred, "p"), "doc").withColumn("shared", F.size(F.array_intersect("t_ends", "p_ends")))
    return rows.select("doc", "t", "p", F.when(F.col("shared") == 0, 1e6).otherwise(F.lit(0.3) * (1 - F.col("shared") / 2) + 0.7).alias("cost"))


def nearest_edge(spark: SparkSession, sf: str) -> DataFrame:
    """The edge of each scene that is nearest to a click: segments between the places of an edge's nodes."""
    at = votes(spark, sf).filter("model_no = 0").select("doc", "id", "x", "y")
    e = corpus(spark, sf, False).edge.select("doc", F.col("id").alias("edge_id"), "a_node", "b_node")
    a, b = at.toDF("doc", "a_node", "ax", "ay"), at.toDF("doc", "b_node", "bx", "by")
    rows = e.join(a, ["doc", "a_node"]).join(b, ["doc", "b_node"])
    d = F.round(S.segment_distance(F.pmod("doc", F.lit(800)).cast("double"), F.pmod("doc", F.lit(400)).cast("double"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 6)
    return rows.withColumn("d", d).groupBy("doc").agg(F.min_by("edge_id", F.struct("d", "edge_id")).alias("edge_id"), F.min("d").alias("distance"))


def _polylines(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    point = lambda k: F.struct((F.col("embedding")[2 * k].cast("double") * 100).alias("x"), (F.col("embedding")[2 * k + 1].cast("double") * 100).alias("y"))
    return e.select("vec_id", F.array(*(point(k) for k in range(4))).alias("points"))


def polyline_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = _polylines(spark, sf).select("vec_id", F.posexplode(S.polyline_samples(F.col("points"))).alias("k", "p"))
    return rows.select("vec_id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def polyline_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each line to the next one, and the anchor of its geometry."""
    rows = _polylines(spark, sf).select("vec_id", F.col("points").alias("line"), S.polyline_samples(F.col("points")).alias("samples")).select("vec_id", F.struct("line", "samples").alias("shape"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("shape").alias("after"))
    none = F.lit(None).cast("array<double>")
    at = G.anchor(F.struct(none.alias("point"), none.alias("bbox"), F.transform("shape.line", lambda p: F.array(p["x"], p["y"])).alias("polyline")))
    apart = G.polyline_distance(F.col("shape"), F.col("after"))
    return rows.join(after, "vec_id").select("vec_id", F.round(apart, 6).alias("distance"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


def detection_matched(spark: SparkSession, sf: str) -> DataFrame:
    """Detection of nodes where a prediction has ids of its own: what the assignment paired is right."""
    v = votes(spark, sf).withColumn("family", F.lit("nodes"))
    truth, found = v.filter("model_no = 0"), v.filter("model_no = 1").withColumn("id", F.concat(F.lit("p-"), "id"))
    matched = matching.matched(truth.drop("family"), found, DIAGONAL).withColumn("family", F.lit("nodes"))
    return metrics.detection(truth, metrics.in_truth_ids(found, matched, {"id": "nodes"}))


def _of_votes(f):
    return lambda spark, sf: f(votes(spark, sf))


QUERIES = {
    "pair_costs": lambda spark, sf: _pair(spark, sf).select("doc", "t_id", "p_id", F.round("cost", 9).alias("cost")), "match_elements": lambda spark, sf: _assigned(spark, sf, 0, 1), "assignment": lambda spark, sf: _assigned(spark, sf, 0, 2),
    "cluster_members": _of_votes(lambda v: matching.clusters(v, DIAGONAL)), "consensus_draft": consensus_draft, "merged_draft": merged_draft, "state_vote": state_vote, "route_keys": route_keys, "detection_matched": detection_matched, "polyline_distance": polyline_distance, "cluster_support": _of_votes(lambda v: consensus.support(v, ["label", "kind"], 3)),
    "median_point": _of_votes(consensus.median_points), "draft_ids": _of_votes(lambda v: consensus.draft_ids(v, "nodes")), "medoid": _of_votes(lambda v: consensus.medoids(v, DIAGONAL)), "translate_refs": translate_refs,
    "draft_closure": draft_closure, "suggestions": suggestions, "provenance_diff": provenance_diff, "review_summary": review_summary, "human_share": human_share, "edge_pair_costs": edge_pair_costs, "nearest_edge": nearest_edge, "polyline_samples": polyline_samples,
    "detection_prf1": lambda spark, sf: metrics.detection(*(all_ids(c) for c in _both(spark, sf))), "state_accuracy": lambda spark, sf: metrics.state_accuracy(*map(_states, _both(spark, sf))), "route_prf1": lambda spark, sf: metrics.route_quality(*map(_routes, _both(spark, sf))),
    "topology_jaccard": lambda spark, sf: metrics.topology_agreement(*(c.edge for c in _both(spark, sf))),
}

_TABLES = ("node", "edge", "signal", "derailer", "route", "route_path", "state_signal", "state_track", "state_switch")
_TWIN = f"WITH {prelude()}, " + ", ".join(f"t_{t} AS (WITH {prelude(t, faults=False)} SELECT * FROM {t})" for t in _TABLES)
_V = f"WITH {prelude('node', faults=False)}, votes AS ({_VOTES})"
_LEV = "CASE WHEN greatest(length(a.label), length(b.label)) = 0 THEN 0 ELSE levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label))::DOUBLE END"
_GEO = f"least(1.0, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (0.05::DOUBLE * {DIAGONAL}::DOUBLE))"
_IDS = lambda p: " UNION ALL ".join(f"SELECT doc, '{f}' AS family, id FROM {p}{t}" for f, t in (("topology/nodes", "node"), ("topology/edges", "edge"), ("signals", "signal"), ("derailers", "derailer"), ("routes", "route")))
_ELS = lambda p: f"SELECT doc, id, kind || '|' || n_half AS content FROM {p}node UNION ALL SELECT doc, id, concat_ws('|', kind, a_node, a_port, b_node, b_port) FROM {p}edge UNION ALL SELECT doc, id, concat_ws('|', kind, at_edge, at_dir) FROM {p}signal WHERE id <> 'n_w'"
_PROV = f"""{_TWIN}, d AS ({_ELS('')}), f AS ({_ELS('t_')}), p AS (SELECT f.doc, f.id, CASE WHEN d.id IS NULL THEN 'human_added' WHEN d.content <> f.content THEN 'human_edited' WHEN d.id LIKE 's%' THEN 'suggestion_accepted' ELSE 'prefill_accepted' END AS origin FROM f LEFT JOIN d ON d.doc = f.doc AND d.id = f.id)"""
_SUM = f"""{_PROV}, s AS (SELECT doc, (SELECT count(*) FROM d WHERE d.doc = p.doc AND d.id NOT LIKE 's%') AS draft_elements, count(*) AS final_elements, count(*) FILTER (origin = 'prefill_accepted') AS prefill_accepted, count(*) FILTER (origin = 'human_edited') AS human_edited,
  count(*) FILTER (origin = 'suggestion_accepted') AS suggestion_accepted, count(*) FILTER (origin = 'human_added') AS human_added, (SELECT count(*) FROM d WHERE d.doc = p.doc AND d.id NOT LIKE 's%' AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc = d.doc AND f.id = d.id)) AS deleted,
  (SELECT count(DISTINCT f.id) FROM f WHERE f.doc = p.doc AND (f.doc + length(f.id)) % 4 <> 1) AS checked FROM p GROUP BY doc)"""
_GRAPH = f"""WITH {prelude()}, el AS MATERIALIZED (SELECT doc, id, (doc + idx) % 3 AS support FROM node UNION ALL SELECT doc, id, (doc + idx) % 3 FROM edge UNION ALL SELECT doc, id, (doc + idx) % 3 FROM signal WHERE id <> 'n_w'),
refs AS MATERIALIZED (SELECT doc, id, a_node AS ref FROM edge UNION ALL SELECT doc, id, b_node FROM edge UNION ALL SELECT doc, id, at_edge FROM signal WHERE id <> 'n_w'),
f0 AS MATERIALIZED (SELECT DISTINCT doc, id FROM el WHERE support >= 2), f1 AS MATERIALIZED (SELECT DISTINCT r.doc, r.ref AS id FROM refs r JOIN f0 ON f0.doc = r.doc AND f0.id = r.id),
f2 AS MATERIALIZED (SELECT DISTINCT r.doc, r.ref AS id FROM refs r JOIN f1 ON f1.doc = r.doc AND f1.id = r.id), f3 AS MATERIALIZED (SELECT DISTINCT r.doc, r.ref AS id FROM refs r JOIN f2 ON f2.doc = r.doc AND f2.id = r.id),
c AS (SELECT * FROM f0 UNION SELECT * FROM f1 UNION SELECT * FROM f2 UNION SELECT * FROM f3),
chosen AS MATERIALIZED (SELECT doc, id FROM c WHERE EXISTS (SELECT 1 FROM el WHERE el.doc = c.doc AND el.id = c.id))"""
_ST = lambda p: f"SELECT doc, 'signals' AS family, id, value FROM {p}state_signal UNION ALL SELECT doc, 'tracks', id, value FROM {p}state_track UNION ALL SELECT doc, 'switches', id, concat_ws('/', position, paths) FROM {p}state_switch"
_RT = lambda p: f"SELECT DISTINCT r.doc, r.start, r.end_id, (SELECT string_agg(edge_id, '>' ORDER BY pos) FROM {p}route_path q WHERE q.doc = r.doc) AS path FROM {p}route r"
_EK = lambda p: f"SELECT DISTINCT doc, least(a_node || '.' || a_port, b_node || '.' || b_port) || '|' || greatest(a_node || '.' || a_port, b_node || '.' || b_port) AS k FROM {p}edge"
_DRAFT = "ids AS (SELECT doc, cluster_no, 'n' || lpad(CAST(row_number() OVER (PARTITION BY doc ORDER BY y, x, cluster_no) AS VARCHAR), 3, '0') AS draft_id FROM (SELECT doc, cluster_no, median(x) AS x, median(y) AS y FROM votes GROUP BY 1, 2))"
_SAMPLES = """WITH p AS (SELECT vec_id, [embedding[k]::DOUBLE * 100 FOR k IN [1, 3, 5, 7]] AS x, [embedding[k]::DOUBLE * 100 FOR k IN [2, 4, 6, 8]] AS y FROM embeddings),
      l AS (SELECT *, sqrt(pow(x[2] - x[1], 2) + pow(y[2] - y[1], 2)) AS a, sqrt(pow(x[3] - x[2], 2) + pow(y[3] - y[2], 2)) AS b, sqrt(pow(x[4] - x[3], 2) + pow(y[4] - y[3], 2)) AS c FROM p),
      s AS (SELECT *, k, (a + b + c) * k / {n} AS w FROM l, range({n} + 1) r(k)), j AS (SELECT *, CASE WHEN w < a THEN 1 WHEN w < a + b THEN 2 ELSE 3 END AS i FROM s),
      f AS (SELECT *, CASE i WHEN 1 THEN w / a WHEN 2 THEN (w - a) / b ELSE (w - a - b) / c END AS t FROM j)"""
#: Every second one of 31 points is one of 16; the one in the middle of the 31 is the anchor.
_APART = """, pt AS (SELECT vec_id, k, x[i] + t * (x[i + 1] - x[i]) AS px, y[i] + t * (y[i + 1] - y[i]) AS py FROM f),
  seg AS (SELECT vec_id, x[i] AS ax, y[i] AS ay, x[i + 1] - x[i] AS dx, y[i + 1] - y[i] AS dy FROM p, range(1, 4) r(i)),
  d AS (SELECT least(pt.vec_id, seg.vec_id) AS vec_id, pt.vec_id < seg.vec_id AS onward, k, min(sqrt(pow(px - ax - greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) * dx, 2)
    + pow(py - ay - greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) * dy, 2))) AS d FROM pt JOIN seg ON seg.vec_id = pt.vec_id + 1 OR seg.vec_id = pt.vec_id - 1 WHERE k % 2 = 0 GROUP BY ALL)
  SELECT d.vec_id, round(avg(d), 6) AS distance, round(any_value(pt.px), 6) AS x, round(any_value(pt.py), 6) AS y FROM d JOIN pt ON pt.vec_id = d.vec_id AND pt.k = 15 GROUP BY d.vec_id"""
SQL = {
    "pair_costs": f"{_V}, c AS (SELECT a.doc, a.id AS t_id, b.id AS p_id, {_LEV} AS l, a.kind <> b.kind AS k, {_GEO} AS g FROM votes a JOIN votes b ON a.doc = b.doc AND a.model_no = 0 AND b.model_no = 1) SELECT doc, t_id, p_id, round(CASE WHEN g >= 1 THEN 1e6 ELSE 0.5::DOUBLE * l + 0.3::DOUBLE * CAST(k AS INT) + 0.2::DOUBLE * g END, 9) AS cost FROM c",
    "cluster_support": f"{_V}, s AS (SELECT doc, cluster_no, count(*) AS support, count(DISTINCT label) > 1 AS l, count(DISTINCT kind) > 1 AS k FROM votes GROUP BY 1, 2) SELECT doc, cluster_no, support, round(support / 3::DOUBLE, 3) AS confidence, concat_ws(',', CASE WHEN l THEN 'label' END, CASE WHEN k THEN 'kind' END) AS disagree, CASE WHEN support * 2 <= 3 THEN 'minority' WHEN l OR k THEN 'contested' ELSE 'consensus' END AS status FROM s",
    "median_point": f"{_V} SELECT doc, cluster_no, median(x) AS x, median(y) AS y FROM votes GROUP BY 1, 2", "draft_ids": f"{_V}, {_DRAFT} SELECT * FROM ids",
    "medoid": f"{_V}, t AS (SELECT a.doc, a.cluster_no, a.member_pos, a.x, a.y, round(sum({_GEO}), 9) AS total FROM votes a JOIN votes b ON a.doc = b.doc AND a.cluster_no = b.cluster_no GROUP BY ALL) SELECT doc, cluster_no, member_pos, x, y FROM (SELECT *, row_number() OVER (PARTITION BY doc, cluster_no ORDER BY total, member_pos) AS n FROM t) WHERE n = 1",
    "translate_refs": f"{_V}, {_DRAFT}, e AS (WITH {prelude('edge', faults=False)} SELECT * FROM edge), r AS (SELECT doc, id, a_node AS ref FROM e UNION ALL SELECT doc, id, b_node FROM e) SELECT r.doc, 1 AS model_no, r.id, coalesce(ids.draft_id, r.ref) AS ref FROM r LEFT JOIN votes v ON v.doc = r.doc AND v.model_no = 1 AND v.id = r.ref LEFT JOIN ids ON ids.doc = v.doc AND ids.cluster_no = v.cluster_no",
    "draft_closure": f"{_GRAPH} SELECT * FROM chosen",
    "suggestions": f"{_GRAPH} SELECT el.doc, el.id, coalesce((SELECT string_agg(DISTINCT ref, ',' ORDER BY ref) FROM refs r WHERE r.doc = el.doc AND r.id = el.id AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc = r.doc AND c.id = r.ref)), '') AS requires FROM (SELECT DISTINCT doc, id FROM el) el WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc = el.doc AND c.id = el.id)",
    "provenance_diff": f"{_PROV} SELECT * FROM p", "review_summary": f"{_SUM} SELECT *, round_even((human_edited + human_added) / greatest(1, final_elements)::DOUBLE, 3) AS human_share FROM s",
    "human_share": f"{_SUM} SELECT CAST(sum(human_edited) AS BIGINT) AS edited, CAST(sum(human_added) AS BIGINT) AS added, CAST(sum(final_elements) AS BIGINT) AS final, round((sum(human_edited) + sum(human_added)) / sum(final_elements), 9) AS human_share FROM s",
    "edge_pair_costs": f"{_TWIN} SELECT t.doc, t.id AS t, p.id AS p, CASE WHEN s = 0 THEN 1e6 ELSE 0.3::DOUBLE * (1 - s / 2::DOUBLE) + 0.7::DOUBLE END AS cost FROM t_edge t JOIN edge p ON p.doc = t.doc, LATERAL (SELECT len(list_intersect([t.a_node, t.b_node], [p.a_node, p.b_node])) AS s)",
    "nearest_edge": f"""{_V}, e AS (WITH {prelude('edge', faults=False)} SELECT * FROM edge), g AS (SELECT e.doc, e.id, e.doc % 800 AS px, e.doc % 400 AS py, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM e JOIN votes a ON a.doc = e.doc AND a.id = e.a_node AND a.model_no = 0 JOIN votes b ON b.doc = e.doc AND b.id = e.b_node AND b.model_no = 0),
      t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM g), d AS (SELECT doc, id, round(sqrt(pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2)), 6) AS d FROM t) SELECT doc, arg_min(id, (d, id)) AS edge_id, min(d) AS distance FROM d GROUP BY doc""",
    "polyline_samples": _SAMPLES.format(n=15) + " SELECT vec_id, CAST(k AS INTEGER) AS k, round(x[i] + t * (x[i + 1] - x[i]), 6) AS x, round(y[i] + t * (y[i + 1] - y[i]), 6) AS y FROM f",
    "polyline_distance": _SAMPLES.format(n=30) + _APART,
    "detection_prf1": f"{_TWIN}, t AS (SELECT DISTINCT * FROM ({_IDS('t_')})), p AS (SELECT DISTINCT * FROM ({_IDS('')})), j AS (SELECT coalesce(t.family, p.family) AS family, t.id AS ti, p.id AS pi FROM t FULL JOIN p ON t.doc = p.doc AND t.family = p.family AND t.id = p.id), c AS (SELECT family, count(*) FILTER (ti IS NOT NULL AND pi IS NOT NULL) AS tp, count(*) FILTER (ti IS NULL) AS fp, count(*) FILTER (pi IS NULL) AS fn FROM j GROUP BY ROLLUP (family)) SELECT family, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c",
    "state_accuracy": f"{_TWIN}, t AS ({_ST('t_')}), p AS ({_ST('')}) SELECT t.family, round(avg(CASE WHEN t.value = p.value AND p.value <> 'unknown' THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM t JOIN p ON t.doc = p.doc AND t.family = p.family AND t.id = p.id GROUP BY 1",
    "route_prf1": f"{_TWIN}, t AS ({_RT('t_')}), p AS ({_RT('')}), j AS (SELECT t.doc AS td, p.doc AS pd FROM t FULL JOIN p ON t.doc = p.doc AND t.start = p.start AND t.end_id = p.end_id AND t.path = p.path), c AS (SELECT count(*) FILTER (td IS NOT NULL AND pd IS NOT NULL) AS tp, count(*) FILTER (td IS NULL) AS fp, count(*) FILTER (pd IS NULL) AS fn FROM j) SELECT *, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c",
    "topology_jaccard": f"{_TWIN}, t AS ({_EK('t_')}), p AS ({_EK('')}) SELECT coalesce(t.doc, p.doc) AS doc, round(count(*) FILTER (t.doc IS NOT NULL AND p.doc IS NOT NULL) / count(*)::DOUBLE, 9) AS jaccard FROM t FULL JOIN p ON t.doc = p.doc AND t.k = p.k GROUP BY 1",
}
