"""Queries of the dataset plane and the prediction log, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import licences as L
from ..functions import scenes as S
from ..operators import ingest
from ..operators import log as log_ops
from ..streaming import latest as streaming


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Licence names, by the key's residue.
_NAMES = ["CC BY 4.0", "CC BY-SA 3.0 de", "CC0", "Public domain", "Attribution", " cc-by-3.0-de ", "PD-US expired", "GFDL", "CC BY-NC 4.0", "CC0 1.0", "CC BY 2.5", None]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Source records from orders: name of the licence, title, size, content, status."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), "o_orderstatus", "o_orderpriority")
    return o.select(
        "key", F.get(F.array(*map(F.lit, _NAMES)), F.pmod("key", F.lit(12)).cast("int")).alias("name"), F.concat(F.lit("File:Panel  "), F.pmod("key", F.lit(977)).cast("string"), F.lit("_[a].jpg")).alias("title"),
        F.sha2(F.concat(F.lit("body"), F.pmod("key", F.lit(5003)).cast("string")), 256).alias("sha256"), (300 + F.pmod("cust", F.lit(900))).alias("width"), (200 + F.pmod("key", F.lit(700))).alias("height"),
        F.when(F.pmod("key", F.lit(11)) == 0, "image/gif").otherwise("image/jpeg").alias("mime"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("pending").alias("status"),
        F.when(F.pmod("key", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("site"), F.pmod("cust", F.lit(40)).cast("string"))).alias("panel_group"), "o_orderpriority",
    )


_RECORDS = f"""records AS (SELECT o_orderkey AS key, [{', '.join('NULL' if n is None else repr(n) for n in _NAMES)}][o_orderkey % 12 + 1] AS name, 'File:Panel  ' || (o_orderkey % 977) || '_[a].jpg' AS title,
  sha256('body' || (o_orderkey % 5003)) AS sha256, 300 + o_custkey % 900 AS width, 200 + o_orderkey % 700 AS height, CASE WHEN o_orderkey % 11 = 0 THEN 'image/gif' ELSE 'image/jpeg' END AS mime,
  CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'site' || (o_custkey % 40) END AS panel_group, o_orderpriority FROM orders),
named AS (SELECT *, CASE WHEN regexp_full_match(trim(name), '(?i)CC[ -]BY[ -]\\d\\.\\d([ -][a-z]{{2,3}})?') THEN 'cc_by' WHEN regexp_matches(trim(name), '(?i)^CC[ -]BY[ -]SA\\b') THEN 'cc_by_sa'
  WHEN lower(trim(name)) IN ('cc0', 'cc0 1.0', 'cc0-1.0') THEN 'cc0' WHEN regexp_full_match(lower(trim(name)), 'public domain|pd([ -].*)?') THEN 'public_domain' WHEN lower(trim(name)) = 'attribution' THEN 'attribution' ELSE 'other' END AS family FROM records),
spdx AS (SELECT *, CASE family WHEN 'cc0' THEN 'CC0-1.0' WHEN 'public_domain' THEN 'LicenseRef-PublicDomain' WHEN 'attribution' THEN 'LicenseRef-Commons-Attribution'
  WHEN 'cc_by' THEN 'CC-BY-' || regexp_extract(name, '\\d\\.\\d') || CASE WHEN regexp_extract(trim(name), '[ -]([A-Za-z]{{2,3}})$', 1) <> '' AND regexp_matches(trim(name), '\\d[ -][A-Za-z]+$') THEN '-' || upper(regexp_extract(trim(name), '[ -]([A-Za-z]{{2,3}})$', 1)) ELSE '' END END AS spdx FROM named)"""
#: One candidate after the other, each shutting out the later ones of its title or content.
_INGEST = f"""WITH RECURSIVE {_RECORDS}, known AS MATERIALIZED (SELECT title, 'commons-' || substr(sha256, 1, 12) AS body FROM records WHERE key % 997 = 5),
hits AS MATERIALIZED (SELECT key, title, CASE WHEN key % 101 <> 0 THEN 'commons-' || substr(sha256, 1, 12) END AS body,
  CASE WHEN spdx IS NULL THEN 'licence_rejected' WHEN mime = 'image/gif' OR width * height < 200000 THEN 'unsuitable' WHEN key % 101 = 0 THEN 'failed' END AS refused,
  title IN (SELECT title FROM known) AS known_title, coalesce(body IN (SELECT body FROM known), false) AS known_body FROM spdx),
open AS MATERIALIZED (SELECT key, title, body FROM hits WHERE refused IS NULL AND NOT known_title AND NOT known_body),
step AS (SELECT key, title, body, 'open' AS state FROM open
  UNION ALL SELECT key, title, body, CASE WHEN first THEN 'new' ELSE 'open' END FROM
    (SELECT *, bool_or(first) OVER (PARTITION BY title) OR bool_or(first) OVER (PARTITION BY body) AS shut FROM
      (SELECT key, title, body, key = min(key) OVER (PARTITION BY title) AND key = min(key) OVER (PARTITION BY body) AS first FROM step WHERE state = 'open')) WHERE first OR NOT shut),
gone_in AS MATERIALIZED (SELECT key, title, body FROM step WHERE state = 'new'),
decided AS (SELECT h.key, h.title, h.body, CASE WHEN known_title OR t.key < h.key THEN 'duplicate' WHEN refused IS NOT NULL THEN refused WHEN known_body OR b.key < h.key THEN 'duplicate' ELSE 'new' END AS reason
  FROM hits h LEFT JOIN gone_in t ON t.title = h.title LEFT JOIN gone_in b ON b.body = h.body)"""
_MD = lambda x: f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '([\\\\`*_\\[\\]<>|])', '\\\\\\1', 'g')"
_SHARE = "CAST(('0x' || substr(sha1({}), 1, 8)) AS BIGINT) % 1000 < 200"


def _hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Search hits in order of key (some downloads fail), and sources that are known already."""
    r = _records(spark, sf)
    ok = F.pmod("key", F.lit(101)) != 0
    hits = r.select("key", "title", F.when(ok, S.source_id(F.col("sha256"))).alias("source_id"), L.spdx_id(F.col("name")).alias("spdx"), "mime", "width", "height", ok.alias("ok"))
    return hits, r.filter("key % 997 = 5").select("title", S.source_id(F.col("sha256")).alias("source_id"))


def ingest_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of an ingest: hits seen, and what became of them."""
    rows = ingest.decided(*_hits(spark, sf))
    return rows.select(F.explode(F.array(F.lit("seen"), "reason")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def ingest_new(spark: SparkSession, sf: str) -> DataFrame:
    """The hits that went in."""
    return ingest.decided(*_hits(spark, sf)).filter("reason = 'new'").select("key", "title", "source_id")


def promote_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Staging into the data plane: accepted rows go in, rows no longer accepted go out, the rest of the plane stays."""
    r = _records(spark, sf)
    staged = r.filter(F.col("o_orderpriority") != "1-URGENT").select("key", "status", F.lit("staged").alias("origin"))
    plane = r.filter(F.col("o_orderpriority") <= "3").select("key", F.lit("plane").alias("held"))
    rows = plane.join(staged, "key", "full_outer")
    keep = F.when(F.col("status") == "accepted", "staged").when(F.col("status").isNull(), "plane")
    return rows.select("key", keep.alias("origin")).filter("origin is not null")


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf).filter("status = 'accepted'").withColumn("scene_id", F.concat(F.lit("k"), F.col("key").cast("string")))
    group = F.coalesce(F.nullif("panel_group", F.lit("")), F.col("scene_id"))
    return r.select("scene_id", S.partition_of(group).alias("partition"), L.spdx_id(F.col("name")).alias("license")).orderBy("scene_id")


def attribution(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf).filter("status = 'accepted'")
    line = L.attribution(F.regexp_replace("title", r"\AFile:", ""), F.nullif("panel_group", F.lit("")), F.coalesce("name", F.lit("none")), F.concat(F.lit("http://x/"), F.col("key").cast("string")), F.when(F.pmod("key", F.lit(2)) == 0, "Own work").otherwise("An  Archive."), F.when(F.pmod("key", F.lit(5)) == 0, "cropped"))
    return r.select("key", line.alias("line"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return log_of(_t(spark, sf, "events"))


def log_of(events: DataFrame) -> DataFrame:
    """A prediction log from events: an event is an attempt of a model (its type) at a scene (its user)."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("user_id").alias("scene_id"), F.col("event_type").alias("model"), F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"), k.alias("tokens"), (~((F.col("event_type") == "error") | (F.coalesce(F.pmod(k, F.lit(7)), F.lit(1)) == 0))).alias("ok"))


_LOG = """log AS (SELECT user_id AS scene_id, event_type AS model, event_id AS seq, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
  NOT (event_type = 'error' OR coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7, 1) = 0) AS ok FROM events)"""
MODELS = ["click", "error", "purchase", "signup", "view", "absent"]


def resume_jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _log(spark, sf)
    return log_ops.open_jobs(rows, MODELS, rows)


def prediction_cost(spark: SparkSession, sf: str) -> DataFrame:
    price = lambda by: F.coalesce(*(F.when(F.col("model") == m, F.lit(p)) for m, p in by.items()))
    pi, po = price({"click": 0.5, "view": 0.25, "purchase": 2.0}), price({"click": 1.5, "view": 1.0, "purchase": 8.0})
    stated = F.when(F.pmod("seq", F.lit(10)) == 0, F.lit(0.125))
    rows = _log(spark, sf).withColumn("cost", S.cost(stated, F.col("tokens"), F.col("tokens") * 2, pi, po))
    return rows.groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("cost").alias("priced"))


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _log(spark, sf).groupBy("model").agg(F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.count("*").alias("n"))
    return rows.select("model", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), "n")


def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    rows = log_ops.majority(_log(spark, sf), ["scene_id"], "model", "seq")
    return rows.select("scene_id", "model", "support", "of", F.round("share", 9).alias("share"))


def docs_for_scene(spark: SparkSession, sf: str) -> DataFrame:
    """The usable last answer of each model, joined to the scene's manifest row (customers)."""
    scenes = _t(spark, sf, "customer").select(F.col("c_custkey").alias("scene_id"), F.col("c_name").alias("image"))
    return log_ops.latest(_log(spark, sf)).filter("ok").join(scenes, "scene_id").select("scene_id", "model", "seq", "image")


def aggregate_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = _log(spark, sf).withColumn("mode", F.when(F.pmod("scene_id", F.lit(2)) == 0, "agentic").otherwise("single_shot"))
    rows = rows.select("model", "mode", F.explode(F.create_map(F.lit("latency"), F.col("latency_ms"), F.lit("success"), F.col("ok").cast("double"))).alias("metric", "value"))
    return rows.groupBy("model", "mode", "metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("value").alias("n"))


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return log_ops.ranked(aggregate_run(spark, sf).select("model", "mode", "metric", "value"), ["model", "mode"])


def task_scenes(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "source")
    return log_ops.first_scenes(docs, F.col("source") == "src0", "doc_id", 25)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("y"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("c"))


def calibration_brier(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).agg(F.round(F.avg(F.pow(F.col("c") - F.col("y"), 2)), 9).alias("brier"), F.count("*").alias("n"))


def calibration_ece(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calibration error over ten bins of equal width."""
    bins = _labels(spark, sf).groupBy(F.least(F.floor(F.col("c") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("acc"), F.avg("c").alias("conf"))
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 9).alias("ece"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring turns of conversations as truth and prediction."""
    from pyspark.sql import Window

    rows = _t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("truth"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("predicted"))
    return rows.filter("predicted is not null")


_TURNS = """turns AS (SELECT * FROM (SELECT conv_id, turn, text AS truth, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS predicted FROM conversations) WHERE predicted IS NOT NULL)"""
#: DuckDB's levenshtein counts bytes: the letters beyond ASCII that the table has become one byte each, for each its own.
_BEYOND = "óéñèíüçêäößÉÑÈÓÜÍÇÖÊÄ"
_BYTES = lambda x: f"translate({x}, '{_BEYOND}', {' || '.join(f'chr({k})' for k in [*range(1, 9), *range(14, 14 + len(_BEYOND) - 8)])})"


def label_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.round(S.label_distance(F.col("truth"), F.col("predicted")), 9).alias("distance"))


def label_cer(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).agg(F.sum(F.levenshtein("truth", "predicted")).cast("long").alias("edits"), F.sum(F.length("truth")).cast("long").alias("chars")).select("edits", "chars", F.round(F.col("edits") / F.col("chars"), 9).alias("cer"))


def label_wer(spark: SparkSession, sf: str) -> DataFrame:
    edits, size = S.word_edits(F.col("truth"), F.col("predicted")), F.size(S.words(F.col("truth")))
    return _turns(spark, sf).agg(F.sum(edits).cast("long").alias("edits"), F.sum(size).cast("long").alias("words"))


def _cols(name: str, key: str, **cols):
    return lambda spark, sf: _t(spark, sf, name).select(key, *(c(spark) if callable(c) and not hasattr(c, "alias") else c.alias(k) for k, c in cols.items()))


def _of_records(**cols):
    return lambda spark, sf: _records(spark, sf).select("key", *(c().alias(k) for k, c in cols.items()))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf)
    x = F.pmod("key", F.lit(1300)) - 100
    y = F.pmod(F.col("key") * 3, F.lit(900)) - 100
    return r.select("key", S.clipped([x, y, x + 50, y + 80], F.col("width"), F.col("height")).alias("b")).select("key", "b.*")


QUERIES = {
    "licence_class": _of_records(family=lambda: L.licence_class(F.col("name"))), "spdx_id": _of_records(spdx=lambda: L.spdx_id(F.col("name"))), "licence_url": _of_records(url=lambda: L.licence_url(F.col("name"), F.col("panel_group"))),
    "assign_partition": _of_records(partition=lambda: S.partition_of(F.col("key"))), "difficulty_tier": _of_records(tier=lambda: S.difficulty(F.col("width") / 2.0, F.col("height") / 4000.0)),
    "source_id": _of_records(source_id=lambda: S.source_id(F.col("sha256"))), "image_scale": _of_records(scale=lambda: F.round(S.image_scale(F.col("width") * 5, F.col("height") * 5), 9)), "clip_boxes": _boxes,
    "html_plain": lambda spark, sf: _t(spark, sf, "pages").select("page_id", L.plain_html(F.col("html")).alias("plain")), "md_escape": lambda spark, sf: _t(spark, sf, "documents").select("doc_id", L.markdown(F.col("text")).alias("md")),
    "extract_json": lambda spark, sf: _t(spark, sf, "events").select("event_id", S.json_span(F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).alias("json")),
    "ingest_funnel": ingest_funnel, "ingest_new": ingest_new, "promote_sync": promote_sync, "manifest_rows": manifest_rows, "attribution": attribution,
    "latest_attempt": lambda spark, sf: log_ops.latest(_log(spark, sf)).select("scene_id", "model", "seq", "ok"), "resume_jobs": resume_jobs, "prediction_cost": prediction_cost, "latency_summary": latency_summary, "majority_vote": majority_vote,
    "docs_for_scene": docs_for_scene, "aggregate_run": aggregate_run, "leaderboard": leaderboard, "task_scenes": task_scenes, "calibration_brier": calibration_brier, "calibration_ece": calibration_ece,
    "label_distance": label_distance, "label_cer": label_cer, "label_wer": label_wer,
    "stream_latest": lambda spark, sf: streaming.latest_of_stream(spark, sf, log_of).select("scene_id", "model", "seq", "ok"), "stream_counters": lambda spark, sf: streaming.counters_of_stream(spark, sf, log_of),
}

_AGG = f"""WITH {_LOG}, long AS (SELECT model, CASE WHEN scene_id % 2 = 0 THEN 'agentic' ELSE 'single_shot' END AS mode, latency_ms, CAST(ok AS DOUBLE) AS okd FROM log),
agg AS (SELECT model, mode, 'latency' AS metric, round(avg(latency_ms), 6) AS value, count(latency_ms) AS n FROM long GROUP BY 1, 2 UNION ALL SELECT model, mode, 'success', round(avg(okd), 6), count(okd) FROM long GROUP BY 1, 2)"""
_LATEST = f"WITH {_LOG} SELECT scene_id, model, max(seq) AS seq, arg_max(ok, seq) AS ok FROM log GROUP BY 1, 2"
_CAL = "WITH l AS (SELECT CAST(quality AS DOUBLE) AS y, (doc_id * 37 % 101) / 100.0 AS c FROM labels)"
SQL = {
    "licence_class": f"WITH {_RECORDS} SELECT key, family FROM named", "spdx_id": f"WITH {_RECORDS} SELECT key, spdx FROM spdx",
    "licence_url": f"WITH {_RECORDS} SELECT key, coalesce(nullif(panel_group, ''), CASE WHEN family = 'attribution' THEN '{L.ATTRIBUTION_URL}' END) AS url FROM named",
    "assign_partition": f"SELECT o_orderkey AS key, CASE WHEN {_SHARE.format('CAST(o_orderkey AS VARCHAR)')} THEN 'test' ELSE 'dev' END AS partition FROM orders",
    "difficulty_tier": f"WITH {_RECORDS} SELECT key, CASE WHEN width / 2.0 < 100 OR height / 4000.0 > 0.15 THEN 'hard' WHEN width / 2.0 < 300 OR height / 4000.0 > 0.05 THEN 'medium' ELSE 'easy' END AS tier FROM records",
    "source_id": f"WITH {_RECORDS} SELECT key, 'commons-' || left(sha256, 12) AS source_id FROM records",
    "image_scale": f"WITH {_RECORDS} SELECT key, round(greatest(1.0, greatest(width, height) * 5 / 2048::DOUBLE), 9) AS scale FROM records",
    "clip_boxes": f"WITH {_RECORDS}, b AS (SELECT key, width, height, key % 1300 - 100 AS x, key * 3 % 900 - 100 AS y FROM records), c AS (SELECT key, greatest(x, 0) AS x0, greatest(y, 0) AS y0, least(x + 50, width) AS x1, least(y + 80, height) AS y1 FROM b) SELECT key, CASE WHEN x0 < x1 AND y0 < y1 THEN x0 END AS x0, CASE WHEN x0 < x1 AND y0 < y1 THEN y0 END AS y0, CASE WHEN x0 < x1 AND y0 < y1 THEN x1 END AS x1, CASE WHEN x0 < x1 AND y0 < y1 THEN y1 END AS y1 FROM c",
    "html_plain": "SELECT page_id, nullif(replace(replace(replace(trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '&amp;', '&'), '&quot;', '\"'), '&#039;', chr(39)), '') AS plain FROM pages",
    "md_escape": f"SELECT doc_id, {_MD('text')} AS md FROM documents",
    "extract_json": "SELECT event_id, regexp_extract(props, '(?s)\\{.*\\}') AS json FROM events",
    "ingest_funnel": f"{_INGEST} SELECT reason, count(*) AS n FROM (SELECT unnest(['seen', reason]) AS reason FROM decided) GROUP BY 1",
    "ingest_new": f"{_INGEST} SELECT key, title, body AS source_id FROM decided WHERE reason = 'new'",
    "promote_sync": f"WITH {_RECORDS} SELECT key, CASE WHEN o_orderpriority <> '1-URGENT' AND status = 'accepted' THEN 'staged' ELSE 'plane' END AS origin FROM records WHERE CASE WHEN o_orderpriority <> '1-URGENT' THEN status = 'accepted' ELSE o_orderpriority <= '3' END",
    "manifest_rows": f"WITH {_RECORDS} SELECT 'k' || key AS scene_id, CASE WHEN {_SHARE.format('CASE WHEN panel_group = ' + chr(39) * 2 + ' THEN ' + chr(39) + 'k' + chr(39) + ' || key ELSE panel_group END')} THEN 'test' ELSE 'dev' END AS partition, spdx AS license FROM spdx WHERE status = 'accepted'",
    "attribution": f"""WITH {_RECORDS} SELECT key, '[' || {_MD("substr(title, 6)")} || '](<http://x/' || key || '>) by ' || CASE WHEN panel_group = '' THEN 'unknown author' ELSE panel_group END || ', ' || {_MD("coalesce(name, 'none')")} || '.' ||
      CASE WHEN key % 2 = 0 THEN '' ELSE ' Credit: An Archive.' END || CASE WHEN key % 5 = 0 THEN ' Modified (cropped).' ELSE '' END AS line FROM records WHERE status = 'accepted'""",
    "latest_attempt": _LATEST, "stream_latest": _LATEST,
    "stream_counters": f"WITH {_LOG} SELECT model, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM log GROUP BY 1",
    "resume_jobs": f"WITH {_LOG}, last AS (SELECT scene_id, model, arg_max(ok, seq) AS ok, count(*) AS n FROM log GROUP BY 1, 2) SELECT s.scene_id, m.model, coalesce(n, 0) + 1 AS attempt FROM (SELECT DISTINCT scene_id FROM log) s CROSS JOIN (VALUES {', '.join(f'({m!r})' for m in MODELS)}) m(model) LEFT JOIN last ON last.scene_id = s.scene_id AND last.model = m.model WHERE n IS NULL OR NOT ok",
    "prediction_cost": f"WITH {_LOG}, c AS (SELECT model, coalesce(CASE WHEN seq % 10 = 0 THEN 0.125 END, (tokens * CASE model WHEN 'click' THEN 0.5::DOUBLE WHEN 'view' THEN 0.25::DOUBLE WHEN 'purchase' THEN 2.0::DOUBLE END + tokens * 2 * CASE model WHEN 'click' THEN 1.5::DOUBLE WHEN 'view' THEN 1.0::DOUBLE WHEN 'purchase' THEN 8.0::DOUBLE END) / 1000) AS cost FROM log) SELECT model, round(sum(cost), 6) AS cost, count(cost) AS priced FROM c GROUP BY 1",
    "latency_summary": f"WITH {_LOG} SELECT model, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, count(*) AS n FROM log GROUP BY 1",
    "majority_vote": f"WITH {_LOG}, c AS (SELECT scene_id, model, count(*) AS n, min(seq) AS f FROM log GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY scene_id) AS t FROM c) SELECT scene_id, model, n AS support, CAST(t AS BIGINT) AS of, round(n / t, 9) AS share FROM r WHERE k = 1",
    "docs_for_scene": f"WITH {_LOG}, last AS (SELECT scene_id, model, max(seq) AS seq, arg_max(ok, seq) AS ok FROM log GROUP BY 1, 2) SELECT scene_id, model, seq, c_name AS image FROM last JOIN customer ON c_custkey = scene_id WHERE ok",
    "aggregate_run": f"{_AGG} SELECT * FROM agg", "leaderboard": f"{_AGG} SELECT model, mode, metric, value, CAST(rank() OVER (PARTITION BY metric ORDER BY value DESC) AS INTEGER) AS rank FROM agg",
    "task_scenes": "SELECT doc_id, source FROM documents WHERE source = 'src0' ORDER BY doc_id LIMIT 25",
    "calibration_brier": f"{_CAL} SELECT round(avg(pow(c - y, 2)), 9) AS brier, count(*) AS n FROM l",
    "calibration_ece": f"{_CAL}, b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(y) AS a, avg(c) AS c FROM l GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 9) AS ece FROM b",
    "label_distance": f"WITH {_TURNS} SELECT conv_id, turn, round(CASE WHEN greatest(length(trim(truth)), length(trim(predicted))) = 0 THEN 0 ELSE levenshtein({_BYTES('trim(truth)')}, {_BYTES('trim(predicted)')}) / greatest(length(trim(truth)), length(trim(predicted)))::DOUBLE END, 9) AS distance FROM turns",
    "label_cer": f"WITH {_TURNS}, s AS (SELECT CAST(sum(levenshtein({_BYTES('truth')}, {_BYTES('predicted')})) AS BIGINT) AS edits, CAST(sum(length(truth)) AS BIGINT) AS chars FROM turns) SELECT edits, chars, round(edits / chars, 9) AS cer FROM s",
}
