"""Ingest of search hits into a set of sources: what becomes of each hit, in the order of the hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import removed, written

MIN_PIXELS = 200_000


def unsuitable(mime: Column, width: Column, height: Column) -> Column:
    """Not a still image, or too small. A missing type is no image; a missing size is 0."""
    pixels = F.coalesce(width, F.lit(0)).cast("long") * F.coalesce(height, F.lit(0))
    return ~F.coalesce(mime, F.lit("")).startswith("image/") | F.coalesce(mime, F.lit("")).eqNullSafe(F.lit("image/gif")) | (pixels < MIN_PIXELS)


def accepted(candidates: DataFrame) -> DataFrame:
    """The candidates (key, title, source_id) that go in when they come in order of key and each shuts out later ones of
    its title or its content.

    A candidate that is the first of its title and of its content, among those still open, goes in; then all that
    share one with it are out. That is repeated until none is open: few rounds, since each one settles at least the
    first candidate of every title whose content is not held up elsewhere. First rows are aggregates, so a hot title
    or content is folded before the shuffle. A null title or content is shared with nobody."""
    whole = F.col("title").isNotNull() & F.col("source_id").isNotNull()
    # a later candidate of the same title and content can't go in, so the first one stands for all
    pairs = candidates.filter(whole).groupBy("title", "source_id").agg(F.min("key").alias("key"))
    open_ = written(pairs.unionByName(candidates.filter(~whole).select("title", "source_id", "key")), "ingest-open")
    rounds = []
    while not open_.isEmpty():
        first = open_
        for column in ("title", "source_id"):
            firsts = open_.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("key").alias(f"_{column}"))
            first = first.join(firsts, column, "left").filter(F.coalesce(f"_{column}", "key") == F.col("key"))
        new = written(first.select("key", "title", "source_id"), "ingest-new")
        rounds.append(new)
        left = open_.join(new.select("title"), "title", "left_anti").join(new.select("source_id"), "source_id", "left_anti")
        left = written(left.join(new.select("key"), "key", "left_anti"), "ingest-open")
        removed(open_)
        open_ = left
    out = open_.select("key", "title", "source_id")  # empty
    for new in rounds:
        out = out.unionByName(new)
    return out


def decided(hits: DataFrame, known: DataFrame) -> DataFrame:
    """hits with reason: new, duplicate, licence_rejected, unsuitable or failed, tested in this order: title seen
    before (known, or of an earlier hit that went in), licence, type and size, download, content seen before.

    hits: key (order of the hits, unique), title, source_id (null where the download failed), spdx, mime, width,
    height, ok. known: title, source_id of sources that are there already. Empty tables give no rows; null titles are
    never seen before."""
    titles = known.select("title", F.lit(True).alias("_known_title")).filter("title is not null").distinct()
    bodies = known.select("source_id", F.lit(True).alias("_known_body")).filter("source_id is not null").distinct()
    rows = hits.join(titles, "title", "left").join(bodies, "source_id", "left")
    refused = F.when(F.col("spdx").isNull(), "licence_rejected").when(unsuitable(F.col("mime"), F.col("width"), F.col("height")), "unsuitable").when(~F.coalesce("ok", F.lit(False)), "failed")
    rows = rows.withColumn("_refused", refused)
    new = accepted(rows.filter("_refused is null and _known_title is null and _known_body is null").select("key", "title", "source_id"))
    by_title = new.filter("title is not null").groupBy("title").agg(F.min("key").alias("_by_title"))
    by_body = new.filter("source_id is not null").groupBy("source_id").agg(F.min("key").alias("_by_body"))
    rows = rows.join(by_title, "title", "left").join(by_body, "source_id", "left")
    seen_title = F.col("_known_title").isNotNull() | F.coalesce(F.col("_by_title") < F.col("key"), F.lit(False))
    seen_body = F.col("_known_body").isNotNull() | F.coalesce(F.col("_by_body") < F.col("key"), F.lit(False))
    reason = F.when(seen_title, "duplicate").when(F.col("_refused").isNotNull(), F.col("_refused")).when(seen_body, "duplicate").otherwise("new")
    return rows.withColumn("reason", reason).select(*hits.columns, "reason")
