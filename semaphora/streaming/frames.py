"""Frames of a scene as they arrive: partial answers, superseded by later ones and at last by the final one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAME = "scene_id string, final boolean, seq long, body string, ts timestamp"
STANDS = "scene_id string, final boolean, seq long, body string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_RANK = ["final", "seq", "body"]


class _Standing(StatefulProcessor):
    """State of a scene: the frame that stands. A timer forgets a scene of which nothing came for a while."""

    def __init__(self, keep_ms: int):
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._stands = handle.getValueState("stands", "final boolean, seq long, body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = tuple(self._stands.get()) if self._stands.exists() else None
        new, seen = old, None
        for r in rows:
            new = max((r.final, r.seq, r.body), new or (r.final, r.seq, r.body))
            seen = max(r.ts, seen or r.ts)
        for timer in self._handle.listTimers():
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(max(int(seen.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self._keep)
        if new != old:
            self._stands.update(new)
            yield Row(scene_id=key[0], final=new[0], seq=new[1], body=new[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._stands.clear()
        return iter(())

    def close(self) -> None:
        pass


def _folded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each scene the frames that outrank all later ones, part by part: whatever the watermark then drops as late, the
    frame that stands is among them. So a scene with very many frames is folded before the shuffle."""
    for part in parts:
        part = part.sort_values(_RANK, ignore_index=True)
        part["_rank"] = part.groupby(_RANK, sort=False).ngroup()
        part = part.sort_values(["ts", "_rank"], ascending=False)
        before = part.groupby("scene_id", sort=False)["_rank"].transform(lambda r: r.cummax().shift(fill_value=-1))
        yield part[part["_rank"] > before].drop(columns="_rank")


def standing(frames: DataFrame, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """Stream of frames (FRAME) -> a row (STANDS) whenever the frame that stands for a scene changes, in update mode.

    A final frame supersedes every partial one, whatever their seq; of two of a kind the larger seq stands, of equal
    ones the larger body. So late partial frames change nothing, nor do repeated rows. Frames later than the watermark
    are dropped, and a scene is forgotten keep_ms of event time after its last frame: state is bounded by the scenes of
    that time. Rows without scene_id, final, seq or ts are none of a scene and are dropped; a null body is an empty one."""
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # the one that knows timers
    whole = frames.select(*(F.coalesce("body", F.lit("")).alias(c) if c == "body" else F.col(c) for c in ("scene_id", "final", "seq", "body", "ts")))
    whole = whole.na.drop(subset=["scene_id", "final", "seq", "ts"])
    rows = whole.mapInPandas(_folded, FRAME).withWatermark("ts", late)
    return rows.groupBy("scene_id").transformWithState(_Standing(keep_ms), STANDS, "Update", "EventTime")


def standing_of_all(frames: DataFrame) -> DataFrame:
    """The same of a table of frames."""
    rows = frames.na.drop(subset=["scene_id", "final", "seq", "ts"]).withColumn("body", F.coalesce("body", F.lit("")))
    best = rows.groupBy("scene_id").agg(F.max(F.struct(*_RANK)).alias("b"))
    return best.select("scene_id", "b.*")
