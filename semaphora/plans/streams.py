"""Queries of documents and frames as they arrive, each equal to the same over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recovery, validator
from ..scene import as_json
from ..sources.bridge import prelude, scenes
from ..sources.shared import written
from ..streaming import frames, latest
from ..streaming.sinks import drained
from .validation import _ALL

_BODIES: dict[tuple[str, str], DataFrame] = {}


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, body): the scenes as JSON texts, some spoilt by the residue of their key: cut off, a list, null, an unknown
    kind, a field that is no field. Written once a session, as files that arrive."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BODIES:
        text, k = as_json(F.col("scene")), F.pmod("doc", F.lit(23))
        body = (
            F.when(k == 0, F.substring(text, 1, 300)).when(k == 1, F.concat(F.lit("["), text, F.lit("]"))).when(k == 2, F.lit(None))
            .when(k == 3, F.replace(text, F.lit('"kind":"joint"'), F.lit('"kind":"turnout"'))).when(k == 4, F.concat(F.lit('{"more":1,'), F.substring(text, 2, 1 << 30))).otherwise(text)
        )
        _BODIES[key] = written(scenes(spark, sf).select("doc", body.alias("body")), "bodies")
    return _BODIES[key]


def validate_documents(spark: SparkSession, sf: str) -> DataFrame:
    return validator.report(validator.validate_documents(bodies(spark, sf)))


def stream_validate(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents as a stream: a stateless projection into a sink that a restart may repeat."""
    arrived = bodies(spark, sf)
    stream = spark.readStream.schema(arrived.schema).parquet(arrived._written_to)
    return drained(spark, validator.report(validator.validate_documents(stream)), "append", "validate")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """A model's answers about the scenes, some spoilt: cut off behind the topology, in a list, null, of an unknown kind,
    with a field that is none, an unknown aspect, a key of a state that is no id, in prose and fences, no JSON."""
    text, k = as_json(F.col("scene")), F.pmod("doc", F.lit(19))
    answer = (
        F.when(k == 0, F.substring(text, F.lit(1), F.instr(text, '"signals":[{') + 14)).when(k == 1, F.concat(F.lit("["), text, F.lit("]"))).when(k == 2, F.lit(None))
        .when(k == 3, F.replace(text, F.lit('"kind":"joint"'), F.lit('"kind":"turnout"'))).when(k == 4, F.concat(F.lit('{"more":1,'), F.substring(text, 2, 1 << 30)))
        .when(k == 5, F.replace(text, F.lit('"aspect":"proceed"'), F.lit('"aspect":"maybe"'))).when(k == 6, F.replace(text, F.lit('"sig_w":{"aspect"'), F.lit('"-":{"aspect"')))
        .when(k == 7, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(k == 8, F.concat(F.lit("Here it is: "), text, F.lit(" as asked."))).when(k == 9, "I can't see it.").when(k == 10, "{broken}").otherwise(text)
    )
    source = F.struct(F.lit("panel_photo").alias("kind"), F.lit("b.png").alias("image"), F.lit(1200).alias("width"), F.lit(600).alias("height"))
    given = (F.lit(1.5).alias("scale"), F.concat(F.lit("s"), F.col("doc").cast("string")).alias("scene_id"), source.alias("source"), F.lit("m").alias("model_id"), F.lit("r").alias("run_id"))
    return scenes(spark, sf).select("doc", answer.alias("answer"), F.col("scene").alias("base"), *given)


def lenient_document(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("scene")
    lists = {"nodes": s["topology"]["nodes"], "edges": s["topology"]["edges"], "signals": s["signals"], "derailers": s["derailers"], "routes": s["routes"]}
    sizes = [F.size(x).cast("long").alias(f"n_{n}") for n, x in lists.items()] + [F.size(s["state"][f]).cast("long").alias(f"n_{f}_states") for f in ("switches", "signals", "tracks")]
    point = F.get(F.filter(lists["nodes"], lambda n: n["id"] == "n_w"), F.lit(0))["geometry"]["point"]
    rows = recovery.lenient_documents(answers(spark, sf)).filter(s.isNotNull())
    return rows.select("doc", s["scene_id"].alias("scene_id"), *sizes, F.get(point, F.lit(0)).alias("px"), F.get(point, F.lit(1)).alias("py"))


def to_annotation(spark: SparkSession, sf: str) -> DataFrame:
    rows = recovery.annotations(answers(spark, sf))
    at = lambda p: F.get_json_object("annotation", f"$.{p}")
    return rows.select("doc", "error", at("scene_id").alias("scene_id"), at("source.width").cast("double").alias("width"), at("provenance.model_id").alias("model_id"), at("topology.nodes[0].geometry.point[0]").cast("double").alias("px"))


def _frames(events: DataFrame) -> DataFrame:
    """Frames from events: an event is a partial answer about a scene (its user), a purchase of at least 20 a final one."""
    final = (F.col("event_type") == "purchase") & (F.col("value") >= 20)
    return events.select(F.col("user_id").cast("string").alias("scene_id"), final.alias("final"), F.col("event_id").alias("seq"), F.col("props").alias("body"), F.col("ts").cast("timestamp").alias("ts"))


def stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    return drained(spark, frames.standing(_frames(latest._events(spark, sf))), "update", "frames", ["scene_id"])


def _counted(events: DataFrame) -> DataFrame:
    """The log with times, modes, outcomes, tokens and cost, from events."""
    k = F.get_json_object("props", "$.k").cast("long")
    ok = F.coalesce(F.pmod(k, F.lit(7)), F.lit(1)) != 0
    status = F.when(F.col("event_type") == "error", "error").when(ok, "ok").otherwise("invalid")
    mode = F.when(F.pmod("user_id", F.lit(2)) == 0, "agentic").otherwise("single_shot")
    numbers = [(F.col("value") * 20).alias("latency_ms"), k.alias("tokens_in"), (k * 3).alias("tokens_out"), (k * 0.25).alias("cost_usd")]
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), mode.alias("mode"), status.alias("status"), *numbers)


def stream_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return latest.counters_by_window(spark, sf, _counted)


QUERIES = {f.__name__: f for f in (validate_documents, lenient_document, to_annotation, stream_validate, stream_frames, stream_histogram)}
_FAULT = """shape AS (SELECT doc, '' AS path FROM scene WHERE doc % 23 IN (0, 1, 2, 4)
  UNION ALL SELECT doc, 'topology/nodes/' || idx || '/kind' FROM node WHERE kind = 'joint' AND doc % 23 = 3),
every AS (SELECT doc, code, severity, element_id, path FROM issues WHERE doc NOT IN (SELECT doc FROM shape) UNION ALL SELECT doc, 'SCHEMA_INVALID', 'error', NULL, path FROM shape)"""
_VALIDATED = f"""{_ALL}, {_FAULT} SELECT scene.doc, count(*) FILTER (severity = 'error') = 0 AS ok, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings,
  coalesce(string_agg(code || '@' || path, ' ' ORDER BY path, code, element_id), '') AS issues FROM scene LEFT JOIN every ON every.doc = scene.doc GROUP BY scene.doc"""
_LE = "CASE " + " ".join(f"WHEN value * 20 <= {e!r} THEN {e!r}" for e in latest.EDGES_MS) + " WHEN value IS NOT NULL THEN 'infinity'::DOUBLE END"
_COUNT = lambda table, where="true": f"(SELECT count(*) FROM {table} t WHERE t.doc = s.doc AND {where})"
_JOINTS = "(SELECT doc, count(*) AS n, min('topology/nodes/' || idx || '/kind') AS first FROM node WHERE kind = 'joint' GROUP BY doc)"
_HAS_NO = "k IN (2, 9, 10)"
_ANSWERS = f"""WITH RECURSIVE {prelude()}, s AS (SELECT scene.*, doc % 19 AS k FROM scene),
w AS (SELECT doc, px * 1.5 AS px, py * 1.5 AS py FROM node WHERE id = 'n_w')"""
SQL = {
    "lenient_document": f"""{_ANSWERS} SELECT s.doc, scene_id, {_COUNT("node", "(k <> 3 OR t.kind <> 'joint')")} AS n_nodes, {_COUNT("edge")} AS n_edges,
      CASE WHEN k = 0 THEN 0 ELSE {_COUNT("signal")} END AS n_signals, CASE WHEN k = 0 THEN 0 ELSE {_COUNT("derailer")} END AS n_derailers, CASE WHEN k = 0 THEN 0 ELSE {_COUNT("route")} END AS n_routes,
      CASE WHEN k = 0 THEN 0 ELSE {_COUNT("state_switch")} END AS n_switches_states, CASE WHEN k = 0 THEN 0 ELSE {_COUNT("state_signal", "(k <> 5 OR t.value <> 'proceed')")} END AS n_signals_states,
      CASE WHEN k = 0 THEN 0 ELSE {_COUNT("state_track")} END AS n_tracks_states, px, py FROM s JOIN w ON w.doc = s.doc WHERE NOT {_HAS_NO} AND k <> 6""",
    "to_annotation": f"""{_ANSWERS}, e AS (SELECT s.doc, CASE WHEN k IN (2, 9) THEN 'no JSON object in the answer' WHEN k IN (0, 10) THEN 'invalid JSON' WHEN k = 3 AND j.n > 0 THEN 'schema: ' || j.n || ' error(s); first: at ' || j.first
      WHEN k = 4 THEN 'schema: 1 error(s); first: at ' WHEN k = 5 THEN 'schema: 1 error(s); first: at state/signals/sig_w/aspect' WHEN k = 6 THEN 'schema: 1 error(s); first: at state/signals/-' END AS error FROM s LEFT JOIN {_JOINTS} j ON j.doc = s.doc)
      SELECT e.doc, error, CASE WHEN error IS NULL THEN 's' || e.doc END AS scene_id, CASE WHEN error IS NULL THEN 1200::DOUBLE END AS width, CASE WHEN error IS NULL THEN 'm' END AS model_id,
      CASE WHEN error IS NULL THEN w.px END AS px FROM e JOIN w ON w.doc = e.doc""",
    "validate_documents": _VALIDATED,
    "stream_validate": _VALIDATED,
    "stream_frames": """SELECT CAST(user_id AS VARCHAR) AS scene_id, bool_or(final) AS final, arg_max(event_id, (final::INT, event_id)) AS seq, coalesce(arg_max(coalesce(props, ''), (final::INT, event_id)), '') AS body
      FROM (SELECT *, event_type = 'purchase' AND value >= 20 AS final FROM events) WHERE user_id IS NOT NULL AND final IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1""",
    "stream_histogram": f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, {_LE} AS le FROM events WHERE ts IS NOT NULL)
      SELECT date_trunc('day', ts)::TIMESTAMP AS begin, event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'agentic' ELSE 'single_shot' END AS mode,
      CASE WHEN event_type = 'error' THEN 'error' WHEN coalesce(k % 7, 1) <> 0 THEN 'ok' ELSE 'invalid' END AS status, le, count(*) AS n, sum(value * 20) AS latency_ms,
      CAST(sum(k) AS BIGINT) AS tokens_in, CAST(sum(k * 3) AS BIGINT) AS tokens_out, sum(k * 0.25::DOUBLE) AS cost_usd FROM e GROUP BY ALL""",
}
