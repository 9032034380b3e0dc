"""A scene document as one nested row: (doc, scene), with scene of the type SCENE.

A look-up in a document names one of its own elements, so everything that concerns single documents is a projection of
this row. The canonical tables of corpus.py are views of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import Corpus

GEOMETRY = "struct<bbox:array<double>,polyline:array<array<double>>,point:array<double>>"
_END = "struct<node:string,port:string>"
_AT = "struct<edge:string,offset:double,direction:string>"
NODE = f"struct<id:string,kind:string,label:string,half_labels:array<string>,geometry:{GEOMETRY},confidence:double>"
EDGE = f"struct<id:string,kind:string,label:string,a:{_END},b:{_END},geometry:{GEOMETRY},confidence:double>"
SIGNAL = f"struct<id:string,kind:string,label:string,system:string,at:{_AT},geometry:{GEOMETRY},confidence:double>"
DERAILER = f"struct<id:string,label:string,at:{_AT},geometry:{GEOMETRY},confidence:double>"
#: A switch position is a word, or a pair of ports as JSON text.
ROUTE = "struct<id:string,label:string,start:string,end:string,path:array<string>,switch_positions:map<string,string>,confidence:double>"
#: Family of states -> what is kept of an element.
STATE_ENTRIES = {
    "switches": "struct<position:string,active_paths:array<array<string>>,raw:string,confidence:double>",
    "signals": "struct<aspect:string,raw:string,confidence:double>",
    "tracks": "struct<occupancy:string,route_set:boolean,confidence:double>",
    "derailers": "struct<position:string,confidence:double>",
    "routes": "struct<status:string,confidence:double>",
}
STATE = f"struct<{','.join(f'{f}:map<string,{entry}>' for f, entry in STATE_ENTRIES.items())},observed_at_ms:bigint>"
SOURCE = "struct<kind:string,image:string,width:int,height:int,frame_index:int,timestamp_ms:bigint>"
PROVENANCE = "struct<kind:string,run_id:string,model_id:string,annotator:string,tool:string,created_at:string>"
SCENE = (
    f"struct<schema_version:string,scene_id:string,source:{SOURCE},provenance:{PROVENANCE},"
    f"topology:struct<nodes:array<{NODE}>,edges:array<{EDGE}>>,signals:array<{SIGNAL}>,derailers:array<{DERAILER}>,"
    f"routes:array<{ROUTE}>,state:{STATE},meta:map<string,string>>"
)
SCENE_FIELDS = ("schema_version", "scene_id", "source", "provenance", "topology", "signals", "derailers", "routes", "state", "meta")
#: Lists of elements, in the order in which their ids are reported: path in a document, type of an element.
LISTS = {"topology/nodes": NODE, "topology/edges": EDGE, "signals": SIGNAL, "derailers": DERAILER, "routes": ROUTE}
STATES = tuple(STATE_ENTRIES)


def field(scene: Column, path: str) -> Column:
    """The value at a path of a scene; a list that is missing is empty."""
    value = scene
    for name in path.split("/"):
        value = value[name]
    return F.coalesce(value, F.array().cast(f"array<{LISTS[path]}>")) if path in LISTS else value


def parsed(docs: DataFrame, body: str = "body", mode: str = "PERMISSIVE") -> DataFrame:
    """(doc, scene) of JSON texts that are right in shape; see documents.schema_issues for the others. With the mode
    FAILFAST a text that is no JSON object is an error."""
    return docs.select("doc", F.from_json(body, SCENE, {"mode": mode}).alias("scene"))


def as_json(scene: Column) -> Column:
    """The document as JSON text, without nulls; pairs of ports as arrays."""
    return F.regexp_replace(F.to_json(scene), r'"\[\\"(\w+)\\",\\"(\w+)\\"\]"', r'["$1","$2"]')


def position_of(setting: Column) -> Column:
    """The position that a switch setting names, null for a pair of ports."""
    return F.when(~setting.startswith("["), setting)


def path_of(setting: Column) -> Column:
    """The pair of ports that a switch setting names, as a path key, null for a position."""
    return F.when(setting.startswith("["), path_key(F.from_json(setting, "array<string>")))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it. (element_at knows its type once; get derives it
    for every row, through all that is nested.)"""
    return F.element_at(F.transform(F.array(value), body), 1)


def path_key(ports: Column) -> Column:
    """Ports in byte order, each once, joined by '-'."""
    return F.array_join(F.array_sort(F.array_distinct(ports)), "-")


def tables(scenes: DataFrame) -> Corpus:
    """The canonical tables of scenes (doc, scene): each a projection of the same rows."""
    scene = F.col("scene")
    each = lambda path: scenes.select("doc", F.posexplode(field(scene, path)).alias("idx", "x"))
    state = lambda name: scenes.select("doc", F.explode(scene["state"][name]).alias("id", "x"))
    at = (F.col("x.at.edge").alias("at_edge"), F.col("x.at.direction").alias("at_dir"), F.col("x.at.offset").alias("at_offset"))
    ends = [F.col(f"x.{e}.{f}").alias(f"{e}_{f}") for e in "ab" for f in ("node", "port")]
    routes = each("routes")
    setting = routes.select("doc", F.col("idx").alias("route_idx"), F.explode("x.switch_positions").alias("node_id", "s"))
    point = F.col("x.geometry.point")
    return Corpus(
        scene=scenes.select("doc", scene["scene_id"].alias("scene_id"), scene["source"]["width"].alias("width"), scene["source"]["height"].alias("height")),
        node=each("topology/nodes").select("doc", "idx", "x.id", "x.kind", F.greatest(F.size("x.half_labels"), F.lit(0)).alias("n_half"), F.get(point, F.lit(0)).alias("px"), F.get(point, F.lit(1)).alias("py")),
        edge=each("topology/edges").select("doc", "idx", "x.id", "x.kind", *ends),
        signal=each("signals").select("doc", "idx", "x.id", "x.kind", *at),
        derailer=each("derailers").select("doc", "idx", "x.id", at[0]),
        route=routes.select("doc", "idx", "x.id", "x.start", F.col("x.end").alias("end_id")),
        route_path=routes.select("doc", F.col("idx").alias("route_idx"), F.posexplode("x.path").alias("pos", "edge_id")),
        route_setting=setting.select("doc", "route_idx", "node_id", position_of(F.col("s")).alias("position"), path_of(F.col("s")).alias("path")),
        state_switch=state("switches").select("doc", "id", "x.position", F.array_join(F.transform("x.active_paths", path_key), "|").alias("paths")),
        state_signal=state("signals").select("doc", "id", F.col("x.aspect").alias("value")),
        state_track=state("tracks").select("doc", "id", F.col("x.occupancy").alias("value")),
        state_derailer=state("derailers").select("doc", "id", F.col("x.position").alias("value")),
        state_route=state("routes").select("doc", "id", F.col("x.status").alias("value")),
    )
