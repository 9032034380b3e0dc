"""Consensus of several models' documents of a scene, and provenance of what a person finalised.

Everything after clustering is relational: a vote is a row (doc, model_no, cluster_no, member_pos, attributes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scenes import point_distance, review_status
from ..scene import let

PREFIX = {"nodes": "n", "edges": "e", "signals": "s", "derailers": "d", "routes": "r"}


def support(votes: DataFrame, attributes: list[str], n_models: int) -> DataFrame:
    """doc, cluster_no, support, confidence, disagree (attributes, joined by ','), status. Null is a value."""
    marked = lambda a: F.coalesce(F.col(a).cast("string"), F.lit("\x00"))
    by = votes.groupBy("doc", "cluster_no").agg(F.count("*").alias("support"), *((F.min(marked(a)) != F.max(marked(a))).alias(f"_{a}") for a in attributes))
    disagree = F.array_compact(F.array(*(F.when(F.col(f"_{a}"), a) for a in attributes)))
    return by.select("doc", "cluster_no", "support", F.bround(F.col("support") / n_models, 3).alias("confidence"), F.array_join(disagree, ",").alias("disagree"), review_status(F.col("support"), F.lit(n_models), F.size(disagree)).alias("status"))


def vote(values: Column) -> tuple[Column, Column]:
    """The most frequent value of a short list, of ties the first (null is a value), and whether there are others."""
    distinct = F.array_distinct(values)
    counts = F.transform(distinct, lambda d: F.size(F.filter(values, lambda v: v.eqNullSafe(d))))
    return F.get(distinct, (F.array_position(counts, F.array_max(counts)) - 1).cast("int")), F.size(distinct) > 1


def median(values: Column) -> Column:
    known = F.sort_array(F.array_compact(values))
    n = F.size(known)
    return (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2


def drafts(votes: DataFrame, family: str, attributes: list[str], n_models: int) -> DataFrame:
    """A row for each cluster of votes (doc, model_no, cluster_no, attributes, x, y): doc, draft_id, the attributes by majority
    (of ties the first model's), support, status, disagree, x, y (medians).

    The same as support(), median_points() and draft_ids() say one by one, but votes are gone through once: dealt out by
    doc, grouped by cluster, and numbered where they are."""
    members = F.sort_array(F.collect_list(F.struct("model_no", *attributes, "x", "y")))
    by = votes.repartition("doc").groupBy("doc", "cluster_no").agg(members.alias("m"))
    best = {a: vote(F.col(f"m.{a}")) for a in attributes}
    n = F.size("m")
    disagree = F.array_compact(F.array(*(F.when(differs, a) for a, (_, differs) in best.items())))
    rows = by.select("doc", "cluster_no", *(value.alias(a) for a, (value, _) in best.items()), n.cast("long").alias("support"), disagree.alias("_d"), median(F.col("m.x")).alias("x"), median(F.col("m.y")).alias("y"))
    status = review_status(F.col("support"), F.lit(n_models), F.size("_d"))
    return rows.select("doc", _draft_id(family).alias("draft_id"), *attributes, "support", status.alias("status"), F.array_join("_d", ",").alias("disagree"), "x", "y")


def median_points(votes: DataFrame) -> DataFrame:
    return votes.groupBy("doc", "cluster_no").agg(F.median("x").alias("x"), F.median("y").alias("y"))


def draft_ids(votes: DataFrame, family: str) -> DataFrame:
    """doc, cluster_no, draft_id: from top to bottom, left to right; clusters without a place come last, as they came."""
    return median_points(votes).select("doc", "cluster_no", _draft_id(family).alias("draft_id"))


def _draft_id(family: str) -> Column:
    w = Window.partitionBy("doc").orderBy(F.col("y").asc_nulls_last(), F.col("x").asc_nulls_last(), "cluster_no")
    n = F.row_number().over(w)
    return F.concat(F.lit(PREFIX[family]), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def medoids(votes: DataFrame, diagonal: float) -> DataFrame:
    """The member of each cluster that is nearest to all others; of equals the first. A cluster has a member for each model."""
    m = votes.filter("x is not null").select("doc", "cluster_no", "member_pos", "x", "y")
    o = m.select("doc", "cluster_no", F.col("x").alias("ox"), F.col("y").alias("oy"))
    total = m.join(o, ["doc", "cluster_no"]).groupBy("doc", "cluster_no", "member_pos", "x", "y").agg(F.round(F.sum(point_distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), F.lit(diagonal))), 9).alias("total"))
    return total.groupBy("doc", "cluster_no").agg(F.min_by(F.struct("member_pos", "x", "y"), F.struct("total", "member_pos")).alias("b")).select("doc", "cluster_no", "b.*")


def members(votes: DataFrame, family: str) -> DataFrame:
    """(doc, model_no, cluster_no, id, draft_id) of votes: what draft_ids() says, with each cluster's members still at hand, so
    that votes are gone through once and joined with nothing."""
    by = votes.groupBy("doc", "cluster_no").agg(F.collect_list(F.struct("model_no", "id", "x", "y")).alias("m"))
    rows = by.select("doc", "cluster_no", "m", median(F.col("m.x")).alias("x"), median(F.col("m.y")).alias("y"))
    rows = rows.select("doc", "cluster_no", "m", _draft_id(family).alias("draft_id"))  # numbered before members are set apart
    return rows.withColumn("m", F.explode("m")).select("doc", "m.model_no", "cluster_no", "m.id", "draft_id")


def translated(references: DataFrame, ids: DataFrame) -> DataFrame:
    """references (doc, model_no, id, ref) with ref in draft ids (ids: doc, model_no, id, draft_id); unknown ones stay.

    Both are grouped by what is named instead of joined, so rows that are dealt out by doc stay where they are. As in a
    join, a reference comes out once for each draft id of its ref, and a null is no name."""
    names = ["doc", "model_no", "ref"]
    none = lambda t: F.lit(None).cast(t)
    known = ids.filter("doc is not null and model_no is not null and id is not null and draft_id is not null")
    known = known.select("doc", "model_no", F.col("id").alias("ref"), "draft_id", none("struct<id:string>").alias("use"))
    rows = references.select(*names, none("string").alias("draft_id"), F.struct(F.col("id").cast("string").alias("id")).alias("use")).unionAll(known.select(*names, "draft_id", "use"))
    by = rows.groupBy(*names).agg(F.collect_list("use").alias("uses"), F.collect_list("draft_id").alias("found"))
    by = by.select(*names, F.explode_outer("found").alias("draft_id"), "uses")
    return by.select("doc", "model_no", F.explode("uses").alias("use"), F.coalesce("draft_id", "ref").alias("ref")).select("doc", "model_no", "use.id", "ref")


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(doc, name) of rows (doc, columns): all that a document has, as one array."""
    return rows.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias(name))


def reached(e: Column, r: Column) -> Column:
    """Ids of a document's elements e (id, enough) that are enough, and all they refer to by r (id, ref) at any depth (three
    steps: routes refer to signals and edges, signals to edges, edges to nodes)."""
    none = F.array().cast("array<string>")

    def steps(front: Column, n: int) -> Column:
        if n == 0:
            return front
        after = lambda f: F.array_distinct(F.transform(F.filter(r, lambda x: F.array_contains(f, x["id"])), lambda x: x["ref"]))
        return let(front, lambda f: F.concat(f, F.when(F.size(f) == 0, none).otherwise(F.coalesce(steps(after(f), n - 1), none))))

    front = F.array_distinct(F.transform(F.filter(e, lambda x: x["enough"]), lambda x: x["id"]))
    return F.array_intersect(F.transform(e, lambda x: x["id"]), steps(front, 3))


def closure(elements: DataFrame, references: DataFrame, min_support: int | Column) -> DataFrame:
    """(doc, id) of elements of enough support and all they refer to. A reference stays in its document, so the steps are
    taken in it."""
    known = elements.select("doc", "id", (F.col("support") >= min_support).alias("enough")).filter("doc is not null and id is not null")
    rows = _listed(known, "e", "id", "enough").join(_listed(references.filter("id is not null and ref is not null"), "r", "id", "ref"), "doc", "left")
    return rows.select("doc", F.explode(reached(F.col("e"), F.col("r"))).alias("id"))


def suggestions(elements: DataFrame, references: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc, id, requires: elements that weren't chosen, and what they refer to that wasn't either."""
    rows = _listed(elements, "e", "id").join(_listed(references.filter("ref is not null"), "r", "id", "ref"), "doc", "left").join(_listed(chosen, "c", "id"), "doc", "left")
    none = F.array().cast("array<string>")
    taken = F.coalesce(F.col("c.id"), none)
    open_ = F.coalesce(F.filter("r", lambda x: ~F.array_contains(taken, x["ref"])), F.array().cast("array<struct<id:string,ref:string>>"))
    rows = rows.select("doc", F.array_except(F.col("e.id"), taken).alias("out"), open_.alias("open"))
    requires = lambda i: F.array_join(F.sort_array(F.array_distinct(F.transform(F.filter("open", lambda x: x["id"] == i), lambda x: x["ref"]))), ",")
    return rows.select("doc", F.inline(F.transform("out", lambda i: F.struct(i.alias("id"), requires(i).alias("requires")))))


def marked(rows: DataFrame, side: str, checked: Column | None = None) -> DataFrame:
    """rows (doc, id, content: what counts, without confidence, as one value) as rows of reviewed(), all of one side: draft,
    suggested or final."""
    sides = (F.lit(side == s).alias(s) for s in ("draft", "suggested", "final"))
    return rows.select("doc", "id", "content", *sides, (F.lit(False) if checked is None else checked).alias("checked"))


def reviewed(rows: DataFrame) -> DataFrame:
    """(doc, id, n_draft, n_final, checked and how many of the final elements are of each origin) of rows (doc, id, content,
    draft, suggested, final, checked: booleans).

    Sides are grouped, not joined: each row is gone through once, and rows that are dealt out by doc stay where they are. As in
    a join, a final element counts once for each draft and suggestion of its id, and a null in a key equals nothing."""
    by = rows.groupBy("doc", "id", "content").agg(*(F.count_if(c).alias(c) for c in ("draft", "suggested", "final", "checked")))
    both = lambda side: F.sum(F.col("final") * F.col(side))
    sums = by.groupBy("doc", "id").agg(*(F.sum(c).alias(f"n_{c}") for c in ("draft", "suggested", "final", "checked")), both("draft").alias("_as_draft"), both("suggested").alias("_as_suggested"))
    known = F.col("doc").isNotNull() & F.col("id").isNotNull()
    of = lambda c: F.when(known, F.col(c)).otherwise(F.lit(0))
    d, s, f = of("n_draft"), of("n_suggested"), F.col("n_final")
    times = F.greatest(s, F.lit(1))
    origins = {
        "prefill_accepted": of("_as_draft") * times, "human_edited": F.when(d > 0, (f * d - F.col("_as_draft")) * times).when(s > 0, f * s - F.col("_as_suggested")).otherwise(F.lit(0)),
        "suggestion_accepted": F.when(d > 0, F.lit(0)).otherwise(of("_as_suggested")), "human_added": F.when((d > 0) | (s > 0), F.lit(0)).otherwise(f),
    }
    ticked = known & (F.col("n_checked") > 0)
    return sums.select("doc", "id", "n_draft", "n_final", ticked.alias("checked"), *(n.cast("long").alias(o) for o, n in origins.items()))


ORIGINS = ("prefill_accepted", "human_edited", "suggestion_accepted", "human_added")


def provenance(rows: DataFrame) -> DataFrame:
    """doc, id, origin of each final element of rows as reviewed() takes them."""
    each = F.flatten(F.array(*(F.array_repeat(F.lit(o), F.col(o).cast("int")) for o in ORIGINS)))
    return reviewed(rows).select("doc", "id", F.explode(each).alias("origin"))


def review_summary(rows: DataFrame) -> DataFrame:
    """Counts for each document of rows as reviewed() takes them, and the share of final elements that a person edited or
    added. Of what was ticked off final elements count, each once; rows without a doc are no draft's."""
    r = reviewed(rows).withColumn("n_draft", F.when(F.col("doc").isNotNull(), F.col("n_draft")).otherwise(F.lit(0)))
    final = sum((F.col(o) for o in ORIGINS[1:]), F.col(ORIGINS[0]))
    sums = r.groupBy("doc").agg(
        F.sum("n_draft").alias("draft_elements"), F.sum(final).alias("final_elements"), *(F.sum(o).alias(o) for o in ORIGINS),
        F.sum(F.when((F.col("n_final") == 0) | F.col("id").isNull(), F.col("n_draft")).otherwise(F.lit(0))).alias("deleted"), F.count_if(F.col("checked") & (F.col("n_final") > 0)).alias("checked"),
    )
    human = F.col("human_edited") + F.col("human_added")
    rows = sums.filter("draft_elements > 0 or final_elements > 0")
    return rows.withColumn("human_share", F.bround(human / F.greatest(F.lit(1), F.col("final_elements")), 3))
