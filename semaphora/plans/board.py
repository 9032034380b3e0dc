"""Queries of the review board, the work list and adopted suggestions, of clicks, degree sequences and file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scenes import partition_of
from ..operators import consensus, metrics, review
from ..sources import files
from ..sources.bridge import corpus
from ..sources.shared import shared_dir
from . import review as views
from .dataset import _SHARE


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc"), "o_orderstatus")


#: The status of an element by its support.
STATUS = ("minority", "contested", "consensus")


def _supported(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of the corpus in order, with the status of their support; some that no model had."""
    elements, _ = views._graph(spark, sf)
    status = F.get(F.array(*map(F.lit, STATUS)), F.col("support").cast("int"))
    return elements.select("doc", "id", status.alias("status"))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct elements of _supported(), with pos: the first place of their id among nodes, edges and signals. Grouped once
    by what they are, so that rows stay where their scenes are."""
    c = corpus(spark, sf)
    support = F.pmod(F.col("doc") + F.col("idx"), F.lit(3))
    parts = ((c.node, support), (c.edge, support), (c.signal, F.when(F.col("id") != "n_w", support)))
    rows = [t.select("doc", "id", (F.lit(k * 10_000) + F.col("idx")).alias("pos"), s.alias("support")) for k, (t, s) in enumerate(parts)]
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2]).filter("doc is not null and id is not null")
    by = rows.groupBy("doc", "id").agg(F.min("pos").alias("pos"), *(F.count_if(F.col("support") == n).alias(s) for n, s in enumerate(STATUS)))
    status = F.array_compact(F.array(*(F.when(F.col(s) > 0, s) for s in STATUS)))
    return by.select("doc", "id", "pos", F.explode(status).alias("status"))


def review_board(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).withColumn("scene_id", F.concat(F.lit("scene-"), F.col("doc").cast("string")))
    manifest = o.select("scene_id", F.concat(F.lit("g"), F.pmod("doc", F.lit(9)).cast("string")).alias("panel_group"), partition_of(F.col("doc")).alias("partition"), F.lit(800).alias("width"), F.lit(400).alias("height"))
    has = lambda n, k: o.filter(F.pmod("doc", F.lit(n)) == k).select("scene_id")
    elements = _supported(spark, sf).select(F.concat(F.lit("scene-"), F.col("doc").cast("string")).alias("scene_id"), "status")
    return review.board(manifest, o.filter(F.pmod("doc", F.lit(5)) != 0).select("scene_id"), has(3, 1), has(7, 2), elements)


def review_worklist(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc") + F.length("id")
    changed = F.when(F.pmod(n, F.lit(6)) == 0, "edited").when(F.pmod(n, F.lit(6)) == 1, "added")
    status = F.when(F.pmod(n, F.lit(11)) != 0, F.col("status"))
    return review.worklist(_placed(spark, sf).select("doc", "pos", "id", status.alias("status"), changed.alias("changed"))).select("doc", "id", "rank", "place")


def adopt_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    rows = views._linked(spark, sf)
    rows = rows.withColumn("in", consensus.reached(F.col("e"), F.col("r")))
    rows = rows.select("doc", F.array_except("e.id", "in").alias("_open"), F.col("r").alias("_links"))
    return review.entering(rows.withColumn("_chosen", F.filter("_open", lambda i: ~i.startswith("n"))))


def nearest_edge_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Polylines from embeddings, eight a scene; a click in each."""
    lines = views._polylines(spark, sf)
    edges = lines.select(F.floor(F.col("vec_id") / 8).alias("doc"), F.pmod("vec_id", F.lit(8)).alias("idx"), F.col("vec_id").alias("edge_id"), "points")
    doc = F.floor(F.col("vec_id") / 8)
    clicks = lines.select(doc.alias("doc")).distinct().select("doc", F.lit(0).alias("click"), (F.pmod(F.col("doc") * 7, F.lit(41)) - 20).cast("double").alias("x"), (F.pmod(F.col("doc") * 13, F.lit(37)) - 18).cast("double").alias("y"))
    return review.nearest_edges(edges, clicks).select("doc", "edge_id", F.round("distance", 6).alias("distance"), F.round("offset", 6).alias("offset"))


def degree_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as prediction, under ids of its own, against its faultless twin; matched by a table of ids."""
    truth, other = views._both(spark, sf)
    own = lambda c: F.concat(F.lit("p_"), F.col(c)).alias(c)
    nodes, edges = other.node.select("doc", own("id")), other.edge.select("doc", own("a_node"), own("b_node"))
    matched = truth.node.select("doc", F.col("id").alias("t_id"), F.concat(F.lit("p_"), F.col("id")).alias("p_id")).filter("(doc + length(t_id)) % 5 <> 0")
    return metrics.degree_agreement(metrics.degrees(truth.node, truth.edge), metrics.degrees(nodes, edges), matched)


def manifest_order(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes written as a manifest of several files in order of their ids, and read back with their places."""
    folder = f"{shared_dir(spark)}/manifest-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    rows = _orders(spark, sf).select(F.concat(F.lit("scene-"), F.lpad(F.col("doc").cast("string"), 12, "0")).alias("scene_id"), F.lit("pilot").alias("split"))
    rows.repartitionByRange(7, "scene_id").sortWithinPartitions("scene_id").write.mode("overwrite").json(folder)
    return files.read_manifest(spark, folder, "scene_id string, split string").select("seq", "scene_id")


QUERIES = {f.__name__: f for f in (review_board, review_worklist, adopt_suggestions, nearest_edge_offset, degree_sequences, manifest_order)}

_G = views._GRAPH
_DEGREE = lambda t: f"SELECT n.doc, n.id, (SELECT count(*) FROM (SELECT doc, a_node AS id FROM {t}edge UNION ALL SELECT doc, b_node FROM {t}edge) e WHERE e.doc = n.doc AND e.id = n.id) AS degree FROM (SELECT DISTINCT doc, id FROM {t}node) n"
SQL = {
    "review_board": f"""{_G}, e AS (SELECT doc, count(*) AS n, count(*) FILTER (support = 2) AS agree FROM el GROUP BY doc)
      SELECT 'scene-' || o_orderkey AS scene_id, 'g' || (o_orderkey % 9) AS panel_group, CASE WHEN {_SHARE.format("o_orderkey::VARCHAR")} THEN 'test' ELSE 'dev' END AS partition, 800 AS width, 400 AS height,
      CASE WHEN o_orderkey % 7 = 2 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'in_progress' WHEN o_orderkey % 5 <> 0 THEN 'todo' ELSE 'no_draft' END AS status,
      CASE WHEN o_orderkey % 5 <> 0 THEN coalesce(e.n, 0) ELSE 0 END AS elements, CASE WHEN o_orderkey % 5 <> 0 THEN coalesce(e.agree, 0) ELSE 0 END AS consensus FROM orders LEFT JOIN e ON e.doc = o_orderkey""",
    "review_worklist": f"""{_G}, place AS (SELECT doc, id, min(pos) AS pos FROM (SELECT doc, id, idx AS pos FROM node UNION ALL SELECT doc, id, 10000 + idx FROM edge UNION ALL SELECT doc, id, 20000 + idx FROM signal) GROUP BY 1, 2),
      r AS (SELECT e.doc, e.id, pos, CASE WHEN (e.doc + length(e.id)) % 6 <= 1 THEN 3 WHEN (e.doc + length(e.id)) % 11 = 0 THEN 0 ELSE support END AS rank FROM (SELECT DISTINCT doc, id, support FROM el) e JOIN place p ON p.doc = e.doc AND p.id = e.id)
      SELECT doc, id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY doc ORDER BY rank, pos, id) AS INTEGER) AS place FROM r""",
    "adopt_suggestions": f"""{_G.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS MATERIALIZED (SELECT DISTINCT doc, id FROM el WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc = el.doc AND c.id = el.id)),
      walk(doc, chosen, id, depth) AS (SELECT doc, id, id, 0 FROM o WHERE id NOT LIKE 'n%' UNION SELECT w.doc, w.chosen, r.ref, w.depth + 1 FROM walk w JOIN refs r ON r.doc = w.doc AND r.id = w.id JOIN o ON o.doc = r.doc AND o.id = r.ref WHERE w.depth < 9),
      deep AS (SELECT doc, chosen, id, max(depth) AS depth FROM walk GROUP BY 1, 2, 3)
      SELECT doc, chosen, id, CAST(row_number() OVER (PARTITION BY doc, chosen ORDER BY depth DESC, id) AS INTEGER) AS step FROM deep""",
    "nearest_edge_offset": """WITH v AS (SELECT vec_id, vec_id // 8 AS doc, [embedding[2 * k + 1]::DOUBLE * 100 FOR k IN [0, 1, 2, 3]] AS xs, [embedding[2 * k + 2]::DOUBLE * 100 FOR k IN [0, 1, 2, 3]] AS ys FROM embeddings),
      s AS (SELECT vec_id, doc, i, xs[i] AS ax, ys[i] AS ay, xs[i + 1] - xs[i] AS dx, ys[i + 1] - ys[i] AS dy, ((doc * 7) % 41 - 20)::DOUBLE AS px, ((doc * 13) % 37 - 18)::DOUBLE AS py FROM v, range(1, 4) r(i)),
      t AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM s),
      d AS (SELECT *, sqrt(pow(px - (ax + t * dx), 2) + pow(py - (ay + t * dy), 2)) AS d, sum(len) OVER (PARTITION BY vec_id) AS total, coalesce(sum(len) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS walked FROM t),
      e AS (SELECT doc, vec_id, min(d) AS d, arg_min(CASE WHEN total > 0 THEN (walked + t * len) / total ELSE 0.5 END, (d, i)) AS offs FROM d GROUP BY 1, 2)
      SELECT doc, arg_min(vec_id, (round(d, 9), vec_id)) AS edge_id, round(arg_min(d, (round(d, 9), vec_id)), 6) AS distance, round(arg_min(offs, (round(d, 9), vec_id)), 6) AS offset FROM e GROUP BY doc""",
    "degree_sequences": f"""{views._TWIN}, t AS ({_DEGREE("t_")}), p AS ({_DEGREE("")}), c AS (SELECT doc, degree, sum(a) AS a, sum(b) AS b FROM (SELECT doc, degree, 1 AS a, 0 AS b FROM t UNION ALL SELECT doc, degree, 0, 1 FROM p) GROUP BY 1, 2)
      SELECT doc, round(sum(least(a, b)) / sum(greatest(a, b)), 9) AS similarity, sum(least(a, b)) = sum(greatest(a, b)) AS same,
      round((SELECT count(*) FROM t JOIN p ON p.doc = t.doc AND p.id = t.id WHERE t.doc = c.doc AND t.degree = p.degree AND (t.doc + length(t.id)) % 5 <> 0) / sum(a), 9) AS matched_share FROM c GROUP BY doc""",
    "manifest_order": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, 'scene-' || lpad(o_orderkey::VARCHAR, 12, '0') AS scene_id FROM orders",
}
