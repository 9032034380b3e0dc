"""Scenes made by rule: a main line of inner nodes between two boundaries, sidings at every port that is left, two
signals, one route over the main line, and full state. Valid by construction; every column of arguments is one scene's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..scene import DERAILER, EDGE, NODE, ROUTE, SCENE, SIGNAL

KINDS = ("joint", "switch", "dkw", "ekw", "crossing")
# The ports by which the main line enters and leaves a node, and those that take a siding.
WEST = {"joint": "A", "switch": "toe", "crossing": "A", "ekw": "A", "dkw": "A"}
EAST = {"joint": "B", "switch": "straight", "crossing": "C", "ekw": "C", "dkw": "C"}
FOUR_PORTS = ("crossing", "ekw", "dkw")


def _of(kind: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), kind)


def _row(type_: str, **values: Column) -> Column:
    """A struct of type_ with the fields given, the others null."""
    return F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(type_[len("struct<") : -1])))


def _inner(n_inner: Column, kind_of) -> Column:
    """(i, id, kind) of the inner nodes."""
    each = lambda i: F.struct(i.alias("i"), F.concat(F.lit("x"), i.cast("string")).alias("id"), kind_of(i).alias("kind"))
    return F.when(n_inner > 0, F.transform(F.sequence(F.lit(0), n_inner - 1), each)).otherwise(F.array().cast("array<struct<i:int,id:string,kind:string>>"))


def _name(prefix: str, i: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), i.cast("string"), F.lit(suffix))


def _nodes(inner: Column) -> Column:
    boundary = lambda name: _row(NODE, id=F.lit(name), kind=F.lit("boundary"), half_labels=F.array())
    buffer = lambda name: _row(NODE, id=name, kind=F.lit("buffer_stop"), half_labels=F.array())

    def of(x: Column) -> Column:
        label, slip = _name("W", x["i"]), x["kind"].isin(rules.SLIPS)
        halves = F.when(slip, F.array(F.concat(label, F.lit("a")), F.concat(label, F.lit("b")))).otherwise(F.array().cast("array<string>"))
        own = _row(NODE, id=x["id"], kind=x["kind"], label=F.when(x["kind"].isin(rules.SWITCHING), label), half_labels=halves)
        two = F.array(own, buffer(_name("b", x["i"], "a")), buffer(_name("b", x["i"], "b")))
        return F.when(x["kind"] == "switch", F.array(own, buffer(_name("b", x["i"])))).when(x["kind"].isin(*FOUR_PORTS), two).otherwise(F.array(own))

    return F.concat(F.array(boundary("n_w")), F.flatten(F.transform(inner, of)), F.array(boundary("n_e")))


def track(id_: Column, kind: str, a: Column | str, a_port: Column | str, b: Column | str, b_port: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    end = lambda node, port: F.struct(text(node).alias("node"), text(port).alias("port"))
    return _row(EDGE, id=id_, kind=F.lit(kind), a=end(a, a_port), b=end(b, b_port))


def _edges(inner: Column) -> Column:
    stop = lambda name, west, east: F.struct(F.lit(name).alias("id"), F.lit(west).alias("west"), F.lit(east).alias("east"))
    passed = lambda x: F.struct(x["id"].alias("id"), _of(x["kind"], WEST).alias("west"), _of(x["kind"], EAST).alias("east"))
    line = F.concat(F.array(stop("n_w", "A", "A")), F.transform(inner, passed), F.array(stop("n_e", "A", "A")))
    pair = lambda west, k: track(_name("m", k), "main", west["id"], west["east"], F.get(line, k + 1)["id"], F.get(line, k + 1)["west"])
    main = F.transform(F.slice(line, F.lit(1), F.size(line) - 1), pair)

    def sidings(x: Column) -> Column:
        side = lambda end, port: track(_name("s", x["i"], end), "siding", x["id"], port, _name("b", x["i"], end), "A")
        none = F.array().cast(f"array<{EDGE}>")
        return F.when(x["kind"] == "switch", F.array(side("", "diverging"))).when(x["kind"].isin(*FOUR_PORTS), F.array(side("a", "B"), side("b", "D"))).otherwise(none)

    return F.concat(main, F.flatten(F.transform(inner, sidings)))


def signal(id_: str, edge: Column, direction: str, offset: float) -> Column:
    at = F.struct(edge.alias("edge"), F.lit(offset).alias("offset"), F.lit(direction).alias("direction"))
    return _row(SIGNAL, id=F.lit(id_), kind=F.lit("main"), system=F.lit("H/V"), at=at)


def generated(rows: DataFrame, n_inner: str | Column, kind_of=None, kinds: Sequence[str] = KINDS, derailer: Column | None = None) -> DataFrame:
    """(doc, scene) for each row of rows (doc and more): a scene of n_inner inner nodes.

    kind_of(i) gives an inner node's kind as a column of rows; by default it is drawn from kinds by a hash of doc and i.
    derailer: whether a derailer stands on the last main edge. A scene with n_inner null or below 0 has none inner."""
    if not kinds or any(k in rules.TERMINAL or k not in rules.PORTS for k in kinds):
        raise ValueError(f"kinds have to be some that are not terminal: {list(kinds)}")
    drawn = lambda i: F.get(F.array(*map(F.lit, kinds)), F.pmod(F.xxhash64("doc", i), F.lit(len(kinds))).cast("int"))
    n = F.coalesce(F.col(n_inner) if isinstance(n_inner, str) else n_inner, F.lit(0)).cast("int")
    rows = rows.select("*", _inner(n, kind_of or drawn).alias("_inner"))
    rows = rows.select("*", _nodes(F.col("_inner")).alias("_nodes"), _edges(F.col("_inner")).alias("_edges"))
    main = F.transform(F.filter("_edges", lambda e: e["kind"] == "main"), lambda e: e["id"])
    last = F.element_at(main, -1)
    switching = F.filter("_inner", lambda x: x["kind"].isin(rules.SWITCHING))
    ids = F.transform(switching, lambda x: x["id"])
    straight = lambda x: F.when(x["kind"] == "switch", "straight").otherwise('["A","C"]')
    route = _row(ROUTE, id=F.lit("rt_w"), label=F.lit("sig_w -> n_e"), start=F.lit("sig_w"), end=F.lit("n_e"), path=main, switch_positions=F.map_from_arrays(ids, F.transform(switching, straight)))
    paths = lambda x: F.when(x["kind"] != "switch", F.array(F.array(F.lit("A"), F.lit("C"))))
    switch = lambda x: F.struct(F.when(x["kind"] == "switch", "straight").alias("position"), paths(x).alias("active_paths"), F.when(x["kind"] == "switch", "+").otherwise("a:+ b:+").alias("raw"))
    has = derailer if derailer is not None else F.lit(False)
    derailers = F.when(has, F.array(_row(DERAILER, id=F.lit("d0"), at=F.struct(last.alias("edge"), F.lit(0.5).alias("offset"), F.lit("a_to_b").alias("direction"))))).otherwise(F.array().cast(f"array<{DERAILER}>"))
    none = lambda type_: F.create_map().cast(f"map<string,{type_}>")
    removed = F.when(has, F.create_map(F.lit("d0"), F.struct(F.lit("removed").alias("position")))).otherwise(none("struct<position:string>"))
    aspect = lambda name, raw: F.struct(F.lit(name).alias("aspect"), F.lit(raw).alias("raw"))
    state = {
        "switches": (F.map_from_arrays(ids, F.transform(switching, switch)), "position:string,active_paths:array<array<string>>,raw:string"),
        "signals": (F.create_map(F.lit("sig_w"), aspect("proceed", "Hp1"), F.lit("sig_e"), aspect("stop", "Hp0")), "aspect:string,raw:string"),
        "tracks": (F.map_from_arrays(F.transform("_edges", lambda e: e["id"]), F.transform("_edges", lambda e: F.struct(F.lit("free").alias("occupancy"), (e["kind"] == "main").alias("route_set")))), "occupancy:string,route_set:boolean"),
        "derailers": (removed, "position:string"),
        "routes": (F.create_map(F.lit("rt_w"), F.struct(F.lit("set").alias("status"))), "status:string"),
    }

    def sure(entries: Column, fields: str) -> Column:
        """The entries with a null confidence."""
        names = [f.split(":")[0] for f in fields.replace("array<array<string>>", "x").split(",")]
        return F.transform_values(entries, lambda _, v: F.struct(*(v[n].alias(n) for n in names), F.lit(None).cast("double").alias("confidence")))

    scene_id = F.concat(F.lit("scene-"), F.col("doc").cast("string"))
    text = lambda x: F.lit(x).cast("string")
    scene = F.struct(
        F.lit("v0").alias("schema_version"), scene_id.alias("scene_id"),
        F.struct(F.lit("synthetic").alias("kind"), F.concat(F.lit("synthetic/"), scene_id, F.lit(".png")).alias("image"), F.lit(800).alias("width"), F.lit(400).alias("height"), F.lit(None).cast("int").alias("frame_index"), F.lit(None).cast("bigint").alias("timestamp_ms")).alias("source"),
        F.struct(F.lit("ground_truth").alias("kind"), *(text(None).alias(f) for f in ("run_id", "model_id", "annotator")), F.lit("generate").alias("tool"), text(None).alias("created_at")).alias("provenance"),
        F.struct(F.col("_nodes").alias("nodes"), F.col("_edges").alias("edges")).alias("topology"),
        F.array(signal("sig_w", F.get(main, F.lit(0)), "a_to_b", 0.1), signal("sig_e", last, "b_to_a", 0.9)).alias("signals"),
        derailers.alias("derailers"), F.array(route).alias("routes"),
        F.struct(*(sure(*v).alias(k) for k, v in state.items()), F.lit(None).cast("bigint").alias("observed_at_ms")).alias("state"),
        F.lit(None).cast("map<string,string>").alias("meta"),
    )
    return rows.select("doc", *(c for c in rows.columns if c != "doc" and not c.startswith("_")), scene.cast(SCENE).alias("scene"))
