"""The review of drafts: scenes by their state, elements by need of a look, suggestions that are adopted, clicks on edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import nearest_on_line
from ..scene import let

#: Steps from a suggestion to what it requires: a route requires signals and edges, a signal edges, an edge nodes.
DEPTH = 4


def board(manifest: DataFrame, drafts: DataFrame, begun: DataFrame, done: DataFrame, elements: DataFrame) -> DataFrame:
    """Each scene of the manifest with its status, and how many elements its draft has and how many of them all agree on.

    drafts, begun, done: scene_id of the files that are there; elements: (scene_id, status) of the drafts' elements, which
    count only where there is a draft. done comes before in_progress, that before todo; no file at all is no_draft. Ids
    that are listed twice count once; scenes that the manifest doesn't have are left out."""
    there = lambda files, name: files.select("scene_id").distinct().withColumn(name, F.lit(True))
    counts = elements.groupBy("scene_id").agg(F.count("*").alias("_n"), F.count_if(F.col("status") == "consensus").alias("_agree"))
    rows = manifest
    for files, name in ((drafts, "_draft"), (begun, "_begun"), (done, "_done")):
        rows = rows.join(there(files, name), "scene_id", "left")
    rows = rows.join(counts, "scene_id", "left")
    status = F.when(F.col("_done"), "done").when(F.col("_begun"), "in_progress").when(F.col("_draft"), "todo").otherwise("no_draft")
    of_draft = lambda c: F.when(F.col("_draft"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select(*manifest.columns, status.alias("status"), of_draft("_n").alias("elements"), of_draft("_agree").alias("consensus"))


def worklist(elements: DataFrame) -> DataFrame:
    """elements (doc, pos, id, status, changed) with rank and place: what needs a look first.

    A changed element (changed: how, null if it isn't) has rank 3, consensus 2, contested 1, minority and elements that
    no model had 0; equal ranks stay in order of pos, equal pos in order of id."""
    known = F.when(F.col("status") == "consensus", 2).when(F.col("status") == "contested", 1).otherwise(0)
    rank = F.when(F.col("changed").isNotNull(), 3).otherwise(known)
    w = Window.partitionBy("doc").orderBy("rank", "pos", "id")
    return elements.withColumn("rank", rank).withColumn("place", F.row_number().over(w))


def open_suggestions(suggested: DataFrame, final: DataFrame) -> DataFrame:
    """Suggestions (doc, id, ...) whose id the document doesn't have yet."""
    return suggested.join(final.select("doc", "id"), ["doc", "id"], "left_anti")


def adopted(chosen: DataFrame, suggested: DataFrame, requires: DataFrame, present: DataFrame) -> DataFrame:
    """(doc, chosen, id, step): what enters a document with a chosen suggestion (doc, id), in order: what a suggestion
    requires (doc, id, ref) before itself, at any depth, each once.

    Ids that are no suggestion, or in the document already, don't enter, nor does what only they require. References go
    down a fixed ladder of families, so DEPTH joins reach all; of one step's elements the smaller id is first."""
    parts = {"_chosen": chosen, "_open": suggested, "_links": requires, "_present": present}
    each = [df.select("doc", F.lit(name).alias("part"), "id", (F.col("ref") if name == "_links" else F.lit(None).cast("string")).alias("ref")) for name, df in parts.items()]
    rows = each[0].unionAll(each[1]).unionAll(each[2]).unionAll(each[3]).filter("doc is not null")
    of = lambda name: F.collect_list(F.when(F.col("part") == name, F.struct("id", "ref"))).alias(name)
    rows = rows.groupBy("doc").agg(*map(of, parts))
    return entering(rows.select("doc", F.col("_chosen.id").alias("_chosen"), "_links", F.array_except("_open.id", "_present.id").alias("_open")))


def entering(rows: DataFrame) -> DataFrame:
    """What adopted() gives, by documents: _chosen and _open (ids of suggestions that can enter), _links (structs of id, ref).
    A document is one row, so nothing is moved."""
    none = F.array().cast("array<string>")
    # of the links those between suggestions that can enter: few
    links = F.coalesce(F.filter("_links", lambda x: F.array_contains("_open", x["id"]) & F.array_contains("_open", x["ref"])), F.array().cast("array<struct<id:string,ref:string>>"))
    rows = rows.select("doc", F.explode(F.array_intersect("_chosen", "_open")).alias("chosen"), links.alias("_links")).filter("chosen is not null")
    step = lambda front: F.array_distinct(F.transform(F.filter("_links", lambda x: F.array_contains(front, x["id"])), lambda x: x["ref"]))

    def deepest_first(front: Column, depth: int) -> Column:
        """What the front requires, then what of the front itself isn't required further down."""
        if depth == 0:
            return F.sort_array(front)
        later = lambda f: let(deepest_first(step(f), depth - 1), lambda found: F.concat(found, F.sort_array(F.array_except(f, found))))
        return let(front, lambda f: F.when(F.size(f) == 0, none).otherwise(later(f)))

    rows = rows.select("doc", "chosen", F.posexplode(deepest_first(F.array("chosen"), DEPTH)).alias("_pos", "id"))
    return rows.select("doc", "chosen", "id", (F.col("_pos") + 1).alias("step"))


def nearest_edges(edges: DataFrame, clicks: DataFrame) -> DataFrame:
    """(doc, click, edge_id, distance, offset) of clicks (doc, click, x, y): the nearest edge of the scene, and where along
    it the nearest point lies, as a share of its length.

    edges: doc, idx, edge_id, points (structs of x and y). Edges of fewer than two points have no place; of equally near
    ones the first in the list counts. A scene without such edges has no row. Distances are compared to 9 decimals."""
    on = nearest_on_line(F.col("points"), F.col("x"), F.col("y"))
    rows = edges.filter(F.size("points") > 1).join(clicks, "doc").withColumn("on", on)
    near = F.struct(F.round("on.distance", 9), "idx", "edge_id")
    best = rows.groupBy("doc", "click").agg(F.min_by(F.struct("edge_id", "on"), near).alias("b"))
    return best.select("doc", "click", "b.edge_id", "b.on.distance", "b.on.offset")
