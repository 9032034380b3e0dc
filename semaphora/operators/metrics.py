"""Metrics of predictions against truth. Stated by the inventory as intended behaviour, so specified here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_truth_ids(rows: DataFrame, matched: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows of predictions (doc, ...) with the ids of the named columns in the truth's ids, so that the metrics below
    compare what was matched. columns: name of a column -> family of its ids. matched: doc, family, t_id, p_id, each
    p_id once. An id without a match gets a '?' before it and equals no id of the truth; null stays null."""
    for name, family in columns.items():
        pairs = matched.filter(F.col("family") == family).select("doc", F.col("p_id").alias(name), F.col("t_id").alias("_t_id"))
        rows = rows.join(pairs, ["doc", name], "left").withColumn(name, F.coalesce("_t_id", F.concat(F.lit("?"), name))).drop("_t_id")
    return rows


def _sides(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The distinct rows of both, with t and p: 1 where truth or predicted has the row, else null. A row with a null equals none
    of the other side. One group of both instead of a full join, so rows that are dealt out by doc stay where they are."""
    side = lambda df, *marks: df.select("*", *(F.lit(v).cast("int").alias(c) for c, v in zip("tp", marks, strict=True)))
    none = F.greatest(*(F.col(c).isNull() for c in truth.columns))
    apart = F.when(none, F.coalesce("t", F.lit(0)))
    rows = side(truth, 1, None).unionAll(side(predicted, None, 1)).groupBy(*truth.columns, apart.alias("_apart"))
    return rows.agg(F.max("t").alias("t"), F.max("p").alias("p")).drop("_apart")


def detection(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 by family and over all (family null). Rows: doc, family, id in one space of ids."""
    keys = ["doc", "family", "id"]
    rows = _sides(truth.select(*keys), predicted.select(*keys)).rollup("family").agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 9)
    f1 = F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 9)
    return rows.select("family", "tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), f1.alias("f1"))


def state_accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of equal states by family, over elements in both; 'unknown' is never right. Rows: doc, family, id, value."""
    p = predicted.select("doc", "family", "id", F.col("value").alias("_p"))
    right = F.when((F.col("value") == F.col("_p")) & (F.col("_p") != "unknown"), 1.0).otherwise(0.0)
    return truth.join(p, ["doc", "family", "id"]).groupBy("family").agg(F.round(F.avg(right), 9).alias("accuracy"), F.count("*").alias("n"))


def route_quality(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """A route is right if start, end and path agree. Rows: doc, id, start, end_id, path (joined edge ids)."""
    keys = ["doc", "start", "end_id", "path"]
    rows = _sides(truth.select(keys), predicted.select(keys)).agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    return rows.select("tp", "fp", "fn", F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 9).alias("f1"))


def topology_agreement(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Jaccard similarity of each scene's sets of port-exact edges. Rows: doc, a_node, a_port, b_node, b_port."""
    a, b = F.concat_ws(".", "a_node", "a_port"), F.concat_ws(".", "b_node", "b_port")
    keyed = lambda df: df.select("doc", F.concat_ws("|", F.least(a, b), F.greatest(a, b)).alias("edge"))
    rows = _sides(keyed(truth), keyed(predicted))
    return rows.groupBy("doc").agg(F.round(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)) / F.count("*"), 9).alias("jaccard"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, id, degree) of every node; loops count twice, ends at unknown nodes don't count."""
    ends = edges.select("doc", F.explode(F.array("a_node", "b_node")).alias("id")).groupBy("doc", "id").agg(F.count("*").alias("degree"))
    return nodes.select("doc", "id").distinct().join(ends, ["doc", "id"], "left").na.fill(0, ["degree"])


def degree_agreement(truth: DataFrame, predicted: DataFrame, matched: DataFrame) -> DataFrame:
    """Agreement of two scenes' degree sequences. Rows of truth and predicted: doc, id, degree; matched: doc, t_id, p_id.

    similarity: of the two sequences as multisets, common part by union (1 for equal ones); same: whether the sorted
    sequences are equal; matched_share: of all nodes of the truth those whose match has their degree. Documents of only
    one side have similarity 0; without nodes on either side there is no row."""
    counts = lambda df, name: df.groupBy("doc", "degree").agg(F.count("*").alias(name))
    both = counts(truth, "t").join(counts(predicted, "p"), ["doc", "degree"], "full_outer").na.fill(0, ["t", "p"])
    rows = both.groupBy("doc").agg(F.sum(F.least("t", "p")).alias("_common"), F.sum(F.greatest("t", "p")).alias("_all"), F.sum("t").alias("_n"))
    t, p = truth.select("doc", F.col("id").alias("t_id"), F.col("degree").alias("_t")), predicted.select("doc", F.col("id").alias("p_id"), F.col("degree").alias("_p"))
    alike = matched.select("doc", "t_id", "p_id").join(t, ["doc", "t_id"]).join(p, ["doc", "p_id"]).groupBy("doc").agg(F.count_if(F.col("_t") == F.col("_p")).alias("_alike"))
    share = F.coalesce("_alike", F.lit(0)) / F.nullif("_n", F.lit(0))
    out = rows.join(alike, "doc", "left")
    return out.select("doc", F.round(F.col("_common") / F.col("_all"), 9).alias("similarity"), (F.col("_common") == F.col("_all")).alias("same"), F.round(share, 9).alias("matched_share"))
