"""Canonical tables of a corpus of scene documents. Every table is keyed by doc; idx is the position in its list."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Families of elements, in the order in which ids are reported.
FAMILIES = ["topology/nodes", "topology/edges", "signals", "derailers", "routes"]


@dataclass
class Corpus:
    """scene(doc, scene_id, width, height) node(doc, idx, id, kind, n_half, px, py) edge(doc, idx, id, kind, a_node,
    a_port, b_node, b_port) signal(doc, idx, id, kind, at_edge, at_dir, at_offset) derailer(doc, idx, id, at_edge)
    route(doc, idx, id, start, end_id) route_path(doc, route_idx, pos, edge_id) route_setting(doc, route_idx, node_id,
    position, path) state_switch(doc, id, position, paths: joined by '|', null if absent) and state_signal,
    state_track, state_derailer, state_route (doc, id, value)."""

    scene: DataFrame
    node: DataFrame
    edge: DataFrame
    signal: DataFrame
    derailer: DataFrame
    route: DataFrame
    route_path: DataFrame
    route_setting: DataFrame
    state_switch: DataFrame
    state_signal: DataFrame
    state_track: DataFrame
    state_derailer: DataFrame
    state_route: DataFrame

    def map(self, f) -> Corpus:
        return Corpus(**{x.name: f(getattr(self, x.name)) for x in fields(self)})


def last_wins(rows: DataFrame) -> DataFrame:
    """One row for each (doc, id): the last in list order, as look-ups see them."""
    w = Window.partitionBy("doc", "id").orderBy(F.desc("idx"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def all_ids(c: Corpus) -> DataFrame:
    """doc, family, idx, id, path of every element of the five families."""
    tables = zip(FAMILIES, (c.node, c.edge, c.signal, c.derailer, c.route), range(5), strict=True)
    parts = [t.select("doc", F.lit(f).alias("family"), F.lit(k).alias("family_no"), "idx", "id", F.concat(F.lit(f + "/"), F.col("idx").cast("string")).alias("path")) for f, t, k in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def endpoints(c: Corpus) -> DataFrame:
    """Two rows for each edge: doc, edge_idx, edge_id, end_name, node, port."""
    end = lambda x: c.edge.select("doc", F.col("idx").alias("edge_idx"), F.col("id").alias("edge_id"), F.lit(x).alias("end_name"), F.col(f"{x}_node").alias("node"), F.col(f"{x}_port").alias("port"))
    return end("a").unionByName(end("b"))
