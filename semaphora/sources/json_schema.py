"""The shape of a document as a JSON Schema, compiled from the table of fields, and whether a kept copy has drifted."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D

DIALECT = "https://json-schema.org/draft/2020-12/schema"
_ID = {"type": "string", "pattern": D.ID}
_NUMBERS = lambda n: {"type": "array", "items": {"type": "number"}, "minItems": n, "maxItems": n}
_PAIR = {"type": "array", "items": {"enum": D.PORTS}, "minItems": 2, "maxItems": 2}
_PLAIN = {
    "id": _ID, "text": {"type": "string"}, "flag": {"type": "boolean"}, "whole": {"type": "integer"}, "size": {"type": "integer", "minimum": 1}, "unit": {"type": "number", "minimum": 0, "maximum": 1},
    "texts": {"type": "array", "items": {"type": "string"}}, "object": {"type": "object"}, "numbers2": _NUMBERS(2), "numbers4": _NUMBERS(4), "points": {"type": "array", "items": _NUMBERS(2)},
    "paths": {"type": "array", "items": _PAIR}, "ids": {"type": "array", "items": _ID, "minItems": 1},
    "settings": {"type": "object", "propertyNames": _ID, "additionalProperties": {"anyOf": [{"enum": D.POSITIONS}, _PAIR]}},
}


def _value(what) -> dict:
    if isinstance(what, dict):
        return compiled(what)
    if isinstance(what, tuple):
        return {"type": "object", "propertyNames": _ID, "additionalProperties": compiled(what[0])}
    if isinstance(what, list):
        return {"type": "array", "items": compiled(what[0])} if isinstance(what[0], dict) else {"enum": what}
    return _PLAIN[what]


def compiled(model: dict) -> dict:
    """The schema of an object whose fields a model of operators.documents names."""
    fields = {name: _value(what) if need != "?" else {"anyOf": [_value(what), {"type": "null"}]} for name, (what, need) in model.items()}
    return {"type": "object", "properties": fields, "required": [n for n, (_, need) in model.items() if need == "!"], "additionalProperties": False}


def text() -> str:
    """The schema as it is kept: the same bytes for the same shape."""
    return json.dumps({"$schema": DIALECT, **compiled(D.SCENE)}, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write(spark: SparkSession, folder: str) -> None:
    """The schema as the one text file of a folder."""
    spark.createDataFrame([(text()[:-1],)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def drift(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, kept, now) of the kept schemas at path: each line that isn't the present one, null where one of the two
    has ended; no row if all bytes are the same."""
    lines = lambda t: F.split(t, "\n", -1)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), lines("value").alias("kept"), lines(F.lit(text())).alias("now"))
    both = files.select("file", F.posexplode(F.arrays_zip("kept", "now")).alias("line", "x"))
    return both.select("file", "line", "x.*").filter(~F.col("kept").eqNullSafe(F.col("now")))
