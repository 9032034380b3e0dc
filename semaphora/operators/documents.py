"""Scene documents as JSON text: what is wrong with their shape, what of a faulty or cut-off one can be used.

A model of the shape is a table of fields. Single elements are checked by expressions over a VARIANT that are compiled from
it, whole documents by shape.py, which goes by the same table. The repair of cut-off text is an Arrow function too."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scene import let
from . import shape

# The pattern of ids and the words that fields may hold.
ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,63}$"
NODE_KINDS = ["buffer_stop", "boundary", "joint", "switch", "crossing", "ekw", "dkw"]
PORTS = ["A", "B", "C", "D", "toe", "straight", "diverging"]
TRACK_KINDS = ["main", "siding", "platform", "yard", "unknown"]
SIGNAL_KINDS = ["main", "distant", "shunt", "combined", "repeater", "block_marker", "unknown"]
ASPECTS = ["stop", "proceed", "proceed_reduced", "expect_stop", "expect_proceed", "expect_proceed_reduced", "shunt_proceed", "dark", "unknown"]
POSITIONS = ["straight", "diverging", "moving", "unknown"]
OCCUPANCY = ["free", "occupied", "unknown"]
DERAILER_POSITIONS = ["applied", "removed", "unknown"]
ROUTE_STATUS = ["not_set", "set", "locked", "releasing", "unknown"]
DIRECTIONS = ["a_to_b", "b_to_a"]
SOURCE_KINDS = ["synthetic", "panel_photo", "estw_screen", "ctc_screen", "stream_frame"]
PROVENANCE_KINDS = ["ground_truth", "prediction"]

# A field: (what it holds, "!" required or "?" may be null or "" may be left out but not null).
# What: a name in _plain, a list of words, a dict (an object), [dict] (a list of objects), (dict,) (a map of objects).
GEOMETRY = {"bbox": ("numbers4", "?"), "polyline": ("points", "?"), "point": ("numbers2", "?")}
_PLACED = {"geometry": (GEOMETRY, "?"), "confidence": ("unit", "?")}
PORT_REF = {"node": ("id", "!"), "port": (PORTS, "!")}
ATTACHMENT = {"edge": ("id", "!"), "offset": ("unit", ""), "direction": (DIRECTIONS, "!")}
NODE = {"id": ("id", "!"), "kind": (NODE_KINDS, "!"), "label": ("text", "?"), "half_labels": ("texts", ""), **_PLACED}
EDGE = {"id": ("id", "!"), "kind": (TRACK_KINDS, ""), "label": ("text", "?"), "a": (PORT_REF, "!"), "b": (PORT_REF, "!"), **_PLACED}
SIGNAL = {"id": ("id", "!"), "kind": (SIGNAL_KINDS, "!"), "label": ("text", "?"), "system": ("text", "?"), "at": (ATTACHMENT, "!"), **_PLACED}
DERAILER = {"id": ("id", "!"), "label": ("text", "?"), "at": (ATTACHMENT, "!"), **_PLACED}
ROUTE = {"id": ("id", "!"), "label": ("text", "?"), "start": ("id", "!"), "end": ("id", "!"), "path": ("ids", "!"), "switch_positions": ("settings", ""), "confidence": ("unit", "?")}
_SURE = {"confidence": ("unit", "?")}
STATE = {
    "switches": (({"position": (POSITIONS, "?"), "active_paths": ("paths", "?"), "raw": ("text", "?"), **_SURE},), ""),
    "signals": (({"aspect": (ASPECTS, ""), "raw": ("text", "?"), **_SURE},), ""),
    "tracks": (({"occupancy": (OCCUPANCY, ""), "route_set": ("flag", "?"), **_SURE},), ""),
    "derailers": (({"position": (DERAILER_POSITIONS, ""), **_SURE},), ""),
    "routes": (({"status": (ROUTE_STATUS, ""), **_SURE},), ""),
    "observed_at_ms": ("whole", "?"),
}
SOURCE = {"kind": (SOURCE_KINDS, "!"), "image": ("text", "!"), "width": ("size", "!"), "height": ("size", "!"), "frame_index": ("whole", "?"), "timestamp_ms": ("whole", "?")}
PROVENANCE = {"kind": (PROVENANCE_KINDS, "!"), **{f: ("text", "?") for f in ("run_id", "model_id", "annotator", "tool", "created_at")}}
#: Lists of elements: path in the document -> model.
ELEMENTS = {"topology.nodes": NODE, "topology.edges": EDGE, "signals": SIGNAL, "derailers": DERAILER, "routes": ROUTE}
SCENE = {
    "schema_version": (["v0"], "!"), "scene_id": ("id", "!"), "source": (SOURCE, "!"), "provenance": (PROVENANCE, "!"),
    "topology": ({"nodes": ([NODE], ""), "edges": ([EDGE], "")}, "!"), "signals": ([SIGNAL], ""), "derailers": ([DERAILER], ""), "routes": ([ROUTE], ""),
    "state": (STATE, "!"), "meta": ("object", ""),
}


def _part(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _among(word: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*map(F.lit, words)), word)


def _plain(what: str | list[str], v: Column, t: Column) -> Column:
    """Whether a value v of type t is what a field without inner fields holds."""
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    whole, is_number = t == "BIGINT", (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL")
    if isinstance(what, list):
        return (t == "STRING") & _among(text, what)
    items = F.try_variant_get(v, "$", "array<variant>")
    type_, text_of = F.schema_of_variant, lambda x: F.try_variant_get(x, "$", "string")
    sure = lambda x: F.coalesce(x, F.lit(False))
    array = lambda x, n, ok: type_(x).startswith("ARRAY") & (F.size(F.try_variant_get(x, "$", "array<variant>")) == n) & F.forall(F.try_variant_get(x, "$", "array<variant>"), ok)
    numeric = lambda x: type_(x).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
    port = lambda x: (type_(x) == "STRING") & sure(_among(text_of(x), PORTS))
    pair = lambda x: sure(array(x, 2, port))
    all_ = lambda ok: t.startswith("ARRAY") & F.forall(items, ok)
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    setting = lambda e: e["key"].rlike(ID) & (((type_(e["value"]) == "STRING") & sure(_among(text_of(e["value"]), POSITIONS))) | pair(e["value"]))
    return {
        "id": lambda: (t == "STRING") & text.rlike(ID), "text": lambda: t == "STRING", "flag": lambda: t == "BOOLEAN", "whole": lambda: whole, "size": lambda: whole & (number >= 1),
        "unit": lambda: is_number & number.between(0, 1), "texts": lambda: all_(lambda x: type_(x) == "STRING"), "object": lambda: t.startswith("OBJECT"),
        "numbers2": lambda: array(v, 2, numeric), "numbers4": lambda: array(v, 4, numeric), "points": lambda: all_(lambda x: sure(array(x, 2, numeric))), "paths": lambda: all_(pair),
        "settings": lambda: t.startswith("OBJECT") & F.forall(entries, setting),
        "ids": lambda: t.startswith("ARRAY") & (F.size(items) > 0) & F.forall(items, lambda x: (type_(x) == "STRING") & sure(text_of(x).rlike(ID))),
    }[what]()


def _fields(v: Column) -> Column:
    """The fields of an object, null for what is none: told without the schema of all that is below."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _object(v: Column, model: dict, path: Column) -> Column:
    return let(_fields(v), lambda m: F.when(m.isNotNull(), problems(m, model, path)).otherwise(F.array(path)))


def _item(path: Column, model: dict):
    return lambda x, i: _object(x, model, F.concat(path, F.lit("/"), i.cast("string")))


def _entry(path: Column, model: dict):
    def check(e: Column) -> Column:
        at = F.concat(path, F.lit("/"), e["key"])
        return F.when(e["key"].rlike(ID), _object(e["value"], model, at)).otherwise(F.array(at))

    return check


def _value(f: Column, what, at: Column) -> Column:
    """Paths at which the value f, which is there and not null, is not what its field holds."""
    none = F.array().cast("array<string>")
    if isinstance(what, dict):
        return _object(f, what, at)
    if isinstance(what, tuple):
        return let(_fields(f), lambda m: F.when(m.isNotNull(), F.flatten(F.transform(F.map_entries(m), _entry(at, what[0])))).otherwise(F.array(at)))
    if isinstance(what[0], dict):
        return let(F.try_variant_get(f, "$", "array<variant>"), lambda items: F.when(items.isNotNull(), F.flatten(F.transform(items, _item(at, what[0])))).otherwise(F.array(at)))
    return let(F.schema_of_variant(f), lambda t: F.when(F.coalesce(_plain(what, f, t), F.lit(False)), none).otherwise(F.array(at)))


def problems(fields: Column, model: dict, path: Column) -> Column:
    """Paths at which an object, given as its fields, is not of the model: an array, empty if all is right.

    A missing or unknown field is reported at the object, a wrong value at the field. Each field is taken out once."""
    none, one = F.array().cast("array<string>"), lambda p: F.array(p)
    parts = [F.when(F.forall(F.map_keys(fields), lambda k: _among(k, list(model))), none).otherwise(one(path))]
    for name, (what, need) in model.items():
        at = F.concat_ws("/", F.nullif(path, F.lit("")), F.lit(name))
        absent = one(path) if need == "!" else none
        void = none if need == "?" else one(at)
        check = lambda f, what=what, at=at, absent=absent, void=void: F.when(f.isNull(), absent).when(F.is_variant_null(f), void).otherwise(_value(f, what, at))
        parts.append(let(F.try_element_at(fields, F.lit(name)), (lambda check: lambda f: check(f))(check)))
    return F.flatten(F.array(*parts))


def shape_problems(body: Column) -> Column:
    """Paths, in order and each once, at which a JSON text is not a scene document; [""] if it is no JSON object. Not for use
    inside a lambda: whole documents are checked by batch, to the paths that problems() has."""
    return shape.problems(body, SCENE)


def schema_issues(docs: DataFrame, body: str = "body") -> DataFrame:
    """doc, code, path: each place at which the JSON text of docs (doc, body) is not a scene document.

    Text that isn't JSON, or not an object, has one issue at the path "". A null body counts as such text; repeated
    rows are reported as often as they come; each path is reported once a row."""
    return docs.select("doc", F.lit("SCHEMA_INVALID").alias("code"), F.explode(shape_problems(F.col(body))).alias("path"))


_ELEMENT = "struct<family:string,idx:int,element:string>"


def _sound(items: Column, family: str, model: dict) -> Column:
    """The items without a problem, each with its family and position, as JSON."""
    placed = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    right = F.filter(placed, lambda s: F.size(_object(s["x"], model, F.lit(""))) == 0)
    return F.transform(right, lambda s: F.struct(F.lit(family).alias("family"), s["i"].alias("idx"), F.to_json(s["x"]).alias("element")).cast(_ELEMENT))


def recovered(docs: DataFrame, body: str = "body") -> DataFrame:
    """doc, family, idx, element (JSON): the elements of faulty documents that are right in themselves; others go.

    Text that isn't a JSON object has none."""
    v = F.try_parse_json(F.col(body))
    lists = [F.coalesce(_sound(_part(v, at, "array<variant>"), at.replace(".", "/"), model), F.array().cast(f"array<{_ELEMENT}>")) for at, model in ELEMENTS.items()]
    return docs.select("doc", F.explode(F.concat(*lists)).alias("e")).select("doc", "e.*")


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|"', re.DOTALL)
_CLOSER = {"{": "}", "[": "]"}


def _closed(text: str | None) -> str | None:
    at = text.find("{") if text else -1
    if at < 0:
        return None
    open_, best = [], None
    for m in _TOKEN.finditer(text, at):
        token = m.group()
        if token in _CLOSER:
            open_.append(_CLOSER[token])
        elif token in ("}", "]"):
            open_.pop()
            best = text[at : m.end()], "".join(reversed(open_))
            if not open_:
                break
        elif token == '"':  # a string that never ends
            break
    if best is None:
        return None
    try:
        return "".join(best) if isinstance(json.loads("".join(best)), dict) else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def repaired(text: pd.Series) -> pd.Series:
    """The complete part of a JSON object that was cut off, with its open brackets closed; null if there is none."""
    return text.map(_closed, na_action="ignore")


def rescaled(numbers: Column, scale: Column) -> Column:
    """Coordinates (an array of numbers) times scale, to one decimal; ties go to the even digit."""
    return F.transform(numbers, lambda x: F.bround(x * scale, 1))
