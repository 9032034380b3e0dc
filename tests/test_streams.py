"""Streams against the same over tables: order of arrival, late rows, a crash between a batch's write and its commit."""

import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from semaphora.operators import validator
from semaphora.plans import streams
from semaphora.sources.shared import shared_dir
from semaphora.streaming import frames, latest, sinks

BEGIN = datetime(2024, 5, 1, tzinfo=timezone.utc)


def arriving(spark, parts, schema):
    """A folder with a file for each part, in order, and the stream that takes one file a batch."""
    folder = f"{shared_dir(spark)}/arrive-{uuid.uuid4().hex}"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def frame(scene, final, seq, body="b", minute=0):
    return (scene, final, seq, body, BEGIN + timedelta(minutes=minute))


PARTS = [
    [frame("a", False, 1), frame("a", False, 3, "c"), frame("a", False, 3, None), frame("b", False, 9), frame("c", True, 5)],
    [frame("a", False, 2, "late"), frame("b", True, 4, "done"), frame("c", False, 8, minute=1), (None, True, 1, "x", BEGIN), frame("c", None, 9), frame("d", False, None)],
    [frame("b", False, 99, "after the end", minute=2), frame("c", True, 6, "again"), frame("c", True, 6, "again"), frame("e", False, 1)],
]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_frames(spark):
    stream = arriving(spark, PARTS, frames.FRAME)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    out = frames.standing(stream)
    sinks.run(out, "update", folder)
    got = sinks.updated(spark, out.schema, folder, ["scene_id"])
    want = frames.standing_of_all(spark.createDataFrame([f for p in PARTS for f in p], frames.FRAME))
    assert rows(got) == rows(want, *got.columns) == [("a", False, 3, "c"), ("b", True, 4, "done"), ("c", True, 6, "again"), ("e", False, 1, "b")]
    changes = sinks.read(spark, out.schema, folder).groupBy("scene_id").count()
    assert rows(changes) == [("a", 1), ("b", 2), ("c", 2), ("e", 1)]  # what is late or repeated changes nothing


def test_frames_of_old_scenes_are_forgotten(spark):
    """Timers: long after a scene's last frame its state goes; what comes later than the watermark is dropped."""
    parts = [[frame("a", True, 5)], [frame("b", False, 1, minute=300)], [frame("b", False, 2, minute=301)], [frame("a", False, 9, "too late", minute=1), frame("a", False, 7, "anew", minute=300)]]
    out = frames.standing(arriving(spark, parts, frames.FRAME), keep_ms=600_000)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    sinks.run(out, "update", folder)
    assert [r for r in rows(sinks.read(spark, out.schema, folder)) if r[0] == "a"] == [("a", False, 7, "anew", 3), ("a", True, 5, "b", 0)]


def crashing(folder, at):
    """The sink, which dies once behind the write of a batch."""
    put, died = sinks.into(folder), []

    def dies(batch, batch_id):
        put(batch, batch_id)
        if batch_id == at and not died:
            died.append(batch_id)
            raise RuntimeError("the driver dies here")

    return dies


def test_validation_survives_a_crash(spark, sf):
    all_ = streams.bodies(spark, sf).filter("doc % 5 = 0")
    parts = [[tuple(r) for r in all_.filter(F.pmod(F.floor(F.col("doc") / 5), F.lit(3)) == k).collect()] for k in range(3)]
    stream = validator.report(validator.validate_documents(arriving(spark, parts, "doc long, body string")))
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    dies = crashing(folder, 1)
    start = lambda: stream.writeStream.foreachBatch(dies).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="the driver dies here"):
        start().awaitTermination()
    start().awaitTermination()
    got = rows(sinks.appended(spark, stream.schema, folder))
    assert len(got) == all_.count()
    assert got == rows(validator.report(validator.validate_documents(all_)))


def test_frames_survive_a_crash(spark):
    out = frames.standing(arriving(spark, PARTS, frames.FRAME))
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    dies = crashing(folder, 1)
    start = lambda: out.writeStream.outputMode("update").foreachBatch(dies).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="the driver dies here"):
        start().awaitTermination()
    start().awaitTermination()
    got = sinks.updated(spark, out.schema, folder, ["scene_id"])
    want = frames.standing_of_all(spark.createDataFrame([f for p in PARTS for f in p], frames.FRAME))
    assert rows(got) == rows(want, *got.columns)


LOG = "ts timestamp, model string, mode string, status string, latency_ms double, tokens_in long, tokens_out long, cost_usd double"


def logged(minute, latency, model="m", **more):
    return (None if minute is None else BEGIN + timedelta(minutes=minute), model, "single_shot", more.get("status", "ok"), latency, 10, more.get("out"), 0.5)


def test_histogram(spark):
    parts = [
        [logged(1, 50.0), logged(2, 50.1), logged(3, None), logged(4, 70_000.0, status="error", out=3), logged(None, 1.0)],
        [logged(70, 99.0), logged(59, 80.0), logged(2, 240.0, "n")],
        [logged(200, 5.0)],
        [logged(5, 60.0), logged(205, 5.0)],  # the first is behind the watermark: it is dropped
    ]
    out = latest.frame_counters(arriving(spark, parts, LOG))
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    sinks.run(out, "update", folder)
    got = sinks.updated(spark, out.schema, folder, ["begin", "model", "mode", "status", "le"])
    kept = [r for p in parts for r in p if r[4] != 60.0]
    want = latest.frame_counters(spark.createDataFrame(kept, LOG))
    assert rows(got) == rows(want)
    first = {(r["le"], r["status"]): (r["n"], r["latency_ms"], r["tokens_in"], r["tokens_out"]) for r in want.filter("model = 'm'").orderBy("begin").collect() if r["begin"].minute == 0 and r["begin"] == min(x["begin"] for x in want.collect())}
    assert first == {(50.0, "ok"): (1, 50.0, 10, None), (100.0, "ok"): (2, 130.1, 20, None), (None, "ok"): (1, None, 10, None), (float("inf"), "error"): (1, 70_000.0, 10, 3)}
