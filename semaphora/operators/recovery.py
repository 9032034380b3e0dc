"""Documents out of answers: the JSON object in prose, coordinates in the original pixels, and what of it is right.

Answers are texts (doc, answer); scale is the factor from the pixels that a model saw to those of the original. The object
is found by expressions; the repair of cut-off text, the rescaling, which goes to any depth, and the checks of shape.py
are Arrow functions of one text.
"""

from __future__ import annotations

import itertools
import json
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scene as typed
from ..functions.scenes import json_span
from . import documents as D
from . import shape

# The fields whose numbers are coordinates.
COORDINATES = ("bbox", "polyline", "point")


def object_in(answer: Column) -> Column:
    """The JSON object of an answer, as a VARIANT: bare, fenced, or in prose (the outermost braces); else null."""
    return F.try_parse_json(json_span(answer))  # what begins with a brace is an object or no JSON


def why_no_object(answer: Column) -> Column:
    """Why an answer has no JSON object, null if it has one."""
    span = json_span(answer)
    return F.when(span.isNull(), "no JSON object in the answer").when(F.try_parse_json(span).isNull(), "invalid JSON")


def _scaled(value, scale: float, inside: bool):
    if isinstance(value, dict):
        return {k: (_scaled(v, scale, k in COORDINATES) if isinstance(v, dict | list) or k in COORDINATES else v) for k, v in value.items()} if not inside else value
    if isinstance(value, list):
        return [_scaled(v, scale, inside) for v in value] if inside else [_scaled(v, scale, False) if isinstance(v, dict | list) else v for v in value]
    number = inside and isinstance(value, int | float) and not isinstance(value, bool)
    return round(value * scale, 1) if number else value


@F.pandas_udf(T.StringType())
def rescaled_text(text: pd.Series, scale: pd.Series) -> pd.Series:
    """A JSON text with the numbers in lists below bbox, polyline and point times scale, to one decimal; all else as it
    is, numbers that are no coordinates, truth values and malformed geometry too. Null without text or scale, or where
    the text is no JSON."""

    def one(t, s):
        try:
            return None if t is None or pd.isna(s) else json.dumps(_scaled(json.loads(t), s, False), ensure_ascii=False)
        except (ValueError, OverflowError):
            return None

    return pd.Series([one(t, s) for t, s in zip(text, scale, strict=True)], dtype=object)


def _typed(v: Column, kind: str) -> Column:
    return F.from_json(F.to_json(v), kind)


#: What a field that is missing stands for, by list of elements and family of states.
_DEFAULTS = {
    "topology.nodes": lambda x: x.setdefault("half_labels", []), "topology.edges": lambda x: x.setdefault("kind", "unknown"), "signals": lambda x: x["at"].setdefault("offset", 0.5),
    "derailers": lambda x: x["at"].setdefault("offset", 0.5), "routes": lambda x: x.setdefault("switch_positions", {}),
}
_STATE_DEFAULTS = {"signals": "aspect", "tracks": "occupancy", "derailers": "position", "routes": "status"}


_KEPT = (
    f"topology struct<nodes:array<{typed.NODE}>,edges:array<{typed.EDGE}>>,signals array<{typed.SIGNAL}>,derailers array<{typed.DERAILER}>,routes array<{typed.ROUTE}>,"
    f"state struct<{','.join(f'{f}:map<string,{entry}>' for f, entry in typed.STATE_ENTRIES.items())}>"
)


def kept_text(text: Column, scale: Column) -> Column:
    """Of a JSON object whose coordinates go times scale as in rescaled_text(): kept, its elements and states that are right in
    themselves, what they leave out filled in, as JSON text, and meta as JSON text, null if it has none. Both null where
    there is no JSON object, no scale, or a state that would be kept has a key that is no id. Not for use inside a lambda."""

    def of_batch(texts: pa.Array, scales: pa.Array) -> pa.Array:
        elements = {path: shape.checked(model) for path, model in D.ELEMENTS.items()}
        states = {f: shape.checked(D.STATE[f][0][0]) for f in typed.STATE_ENTRIES}
        written = lambda v: shape.encoded(json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True))

        def right(check, x) -> bool:
            wrong: list[str] = []
            check(x, "", wrong)
            return not wrong

        def at(v, *way: str):
            for name in way:
                v = v.get(name) if isinstance(v, dict) else None
            return v

        def one(t: str, s: float) -> dict | None:
            v = _scaled(json.loads(t), s, False)
            if not isinstance(v, dict):
                return None
            json.dumps(v, allow_nan=False)  # a number that JSON has not: the whole is no JSON
            found = {path: at(v, *path.split(".")) for path in elements}
            lists = {path: [x for x in items if right(elements[path], x)] if isinstance(items, list) else [] for path, items in found.items()}
            entries = {f: at(v, "state", f) for f in states}
            kept = {f: {k: x for k, x in m.items() if right(states[f], x)} if isinstance(m, dict) else {} for f, m in entries.items()}
            if shape.too_deep(v, t) or not all(map(shape.is_id, itertools.chain(*kept.values()))):
                return None
            for path, items in lists.items():
                for x in items:
                    _DEFAULTS[path](x)
            for f, name in _STATE_DEFAULTS.items():
                for x in kept[f].values():
                    x.setdefault(name, "unknown")
            topology = {"nodes": lists.pop("topology.nodes"), "edges": lists.pop("topology.edges")}
            return {"kept": written({"topology": topology, **lists, "state": kept}), "meta": written(v["meta"]) if "meta" in v else None}

        out = []
        for t, s in zip(shape.texts_of(texts), scales.to_pylist(), strict=True):
            try:
                out.append(None if t is None or s is None or math.isnan(s) else one(t, s))
            except (ValueError, OverflowError, RecursionError):
                out.append(None)
        return pa.array(out, pa.struct([("kept", pa.string()), ("meta", pa.string())]))

    # called so that a filter on what comes out isn't pushed below, where it would find the object and keep all a second time
    return F.arrow_udf(of_batch, "struct<kept:string,meta:string>").asNondeterministic()(text, scale)


def _objects(answers: DataFrame, answer: str, repair: bool) -> DataFrame:
    """answers with _body: the object of the answer as text, or what repair gives of a cut-off one."""
    found = F.to_json(object_in(F.col(answer)))
    rows = answers.withColumn("_body", found)
    return rows.withColumn("_body", F.coalesce("_body", D.repaired(F.when(F.col("_body").isNull(), F.col(answer))))) if repair else rows


def lenient_documents(answers: DataFrame, answer: str = "answer", base: str = "base") -> DataFrame:
    """(doc, scene) of answers (doc, answer, scale, base): each element and state that is right in itself, others are
    dropped; an answer that was cut off gives what it holds completely.

    base, a scene, gives schema_version, scene_id, source and provenance. Coordinates are times scale. scene is null
    without a JSON object, and where a state that would be kept has a key that is no id. Null answers, scales or bases
    give null; repeated rows come out as often as they went in."""
    rows = _objects(answers, answer, repair=True).withColumn("_text", kept_text(F.col("_body"), F.col("scale").cast("double")))
    rows = rows.withColumn("_kept", F.from_json("_text.kept", _KEPT))
    header, kept = F.col(base), F.col("_kept")
    meta = F.coalesce(_typed(F.try_parse_json("_text.meta"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    state = F.struct(*(kept["state"][f].alias(f) for f in typed.STATE_ENTRIES), F.lit(None).cast("bigint").alias("observed_at_ms"))
    parts = {**{f: header[f] for f in ("schema_version", "scene_id", "source", "provenance")}, **{p: kept[p] for p in ("topology", "signals", "derailers", "routes")}, "state": state, "meta": meta}
    scene = F.struct(*(x.alias(n) for n, x in parts.items()))
    return rows.select("doc", F.when(F.col("_text.kept").isNotNull() & header.isNotNull(), scene).alias("scene"))


def annotations(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(doc, annotation, error) of answers (doc, answer, scale, scene_id, source, model_id, run_id), strictly.

    annotation: the answer's object as JSON text, its coordinates times scale, its schema_version, scene_id, source (a
    struct of kind, image, width, height) and provenance overwritten. Where the answer has no object, or the result
    isn't a scene document, annotation is null and error says why, in one line: what is wrong first, by path, and at how
    many places. Exactly one of the two is null."""
    rows = _objects(answers, answer, repair=False)
    rows = rows.withColumn("_v", F.try_parse_json(rescaled_text("_body", F.col("scale").cast("double"))))
    provenance = F.struct(F.lit("prediction").alias("kind"), F.col("model_id").cast("string").alias("model_id"), F.col("run_id").cast("string").alias("run_id"))
    header = {"schema_version": F.lit("v0"), "scene_id": F.col("scene_id").cast("string"), "source": F.col("source"), "provenance": provenance}
    fields = F.create_map(*(x for n, c in header.items() for x in (F.lit(n), F.parse_json(F.to_json(c)) if n in ("source", "provenance") else F.parse_json(F.to_json(F.struct(c.alias("c")))))))
    plain = F.transform_values(fields, lambda n, x: F.when(n.isin("schema_version", "scene_id"), F.try_variant_get(x, "$.c", "variant")).otherwise(x))
    own = F.map_filter(F.try_variant_get(F.col("_v"), "$", "map<string,variant>"), lambda n, _: ~n.isin(*header))
    rows = rows.withColumn("_text", F.when(F.col("_v").isNotNull(), F.to_json(F.map_concat(own, plain))))
    rows = rows.withColumn("_wrong", F.when(F.col("_text").isNotNull(), D.shape_problems(F.col("_text"))))
    places = F.size("_wrong")
    summary = F.concat(F.lit("schema: "), places.cast("string"), F.lit(" error(s); first: at "), F.get("_wrong", F.lit(0)))
    error = F.when(F.col("_text").isNull(), F.coalesce(why_no_object(F.col(answer)), F.lit("no scale"))).when(places > 0, summary)
    return rows.select("doc", F.when(places == 0, F.col("_text")).alias("annotation"), error.alias("error"))
