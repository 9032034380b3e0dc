"""The rules tables of track diagrams: which ports a node kind has and which paths through it are possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Kind -> ports, paths (ports in byte order, joined by '-'), families of paths that may be set together.
PORTS = {
    "buffer_stop": ["A"], "boundary": ["A"], "joint": ["A", "B"], "switch": ["toe", "straight", "diverging"],
    "crossing": ["A", "B", "C", "D"], "ekw": ["A", "B", "C", "D"], "dkw": ["A", "B", "C", "D"],
}
PATHS = {"joint": ["A-B"], "switch": ["straight-toe", "diverging-toe"], "crossing": ["A-C", "B-D"], "ekw": ["A-C", "B-D", "A-D"], "dkw": ["A-C", "B-D", "A-D", "B-C"]}
FAMILIES = {"crossing": [["A-C", "B-D"]], "ekw": [["A-C", "B-D"], ["A-D"]], "dkw": [["A-C", "B-D"], ["A-D", "B-C"]]}
SWITCHING, SLIPS, TERMINAL = ["switch", "ekw", "dkw"], ["ekw", "dkw"], ["buffer_stop", "boundary"]
SWITCH_POSITIONS = {"straight-toe": "straight", "diverging-toe": "diverging"}
PROMOTED = ["GEOM_OUT_OF_BOUNDS", "STATE_MISSING", "ROUTE_SWITCH_MISSING"]
WARNINGS = [*PROMOTED, "NODE_HALF_LABELS_UNEXPECTED"]


def degree(kind: str) -> int:
    return len(PORTS[kind])


def expected_setting(kind: str, path: str) -> str | None:
    """What a switching node has to be set to for a path through it: a position for a switch, the path for a slip."""
    return SWITCH_POSITIONS.get(path) if kind == "switch" else path if kind in SLIPS else None


def ports_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, p) for k, ports in PORTS.items() for p in ports], "kind string, port string")


def degrees_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, degree(k)) for k in PORTS], "kind string, degree int")


def paths_table(spark: SparkSession) -> DataFrame:
    rows = [(k, p, expected_setting(k, p), k in SWITCHING) for k, paths in PATHS.items() for p in paths]
    return spark.createDataFrame(rows, "kind string, path string, setting string, switching boolean")
