"""The ingest, hit by hit, against the same told as a plain loop."""

import random

import pytest

from semaphora.operators import ingest

HIT = "key long, title string, source_id string, spdx string, mime string, width int, height int, ok boolean, reason string"


def by_loop(hits, known):
    titles, bodies, out = {t for t, _ in known}, {b for _, b in known}, {}
    for key, title, body, spdx, mime, width, height, ok, _ in sorted(hits):
        if title is not None and title in titles:
            out[key] = "duplicate"
        elif spdx is None:
            out[key] = "licence_rejected"
        elif not (mime or "").startswith("image/") or mime == "image/gif" or (width or 0) * (height or 0) < 200000:
            out[key] = "unsuitable"
        elif not ok:
            out[key] = "failed"
        elif body is not None and body in bodies:
            out[key] = "duplicate"
        else:
            out[key] = "new"
            titles.add(title)
            bodies.add(body)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_loop(spark, seed):
    draw = random.Random(seed)
    maybe = lambda v, p=0.03: None if draw.random() < p else v
    hits = [
        (k, maybe("hot" if draw.random() < 0.3 else f"t{draw.randrange(300)}"), maybe("same" if draw.random() < 0.3 else f"b{draw.randrange(200)}"), maybe("CC0-1.0", 0.2), maybe(draw.choice(["image/jpeg", "image/png", "image/gif", "video/ogg"])), maybe(700), maybe(draw.choice([300, 200])), maybe(draw.random() < 0.9), "kept?")
        for k in range(400)
    ]
    known = [("t1", "b1"), (None, "b2"), ("t3", None), ("t1", "b1")]
    rows = ingest.decided(spark.createDataFrame(hits, HIT).drop("reason"), spark.createDataFrame(known, "title string, source_id string")).collect()
    want = by_loop(hits, known)
    assert len(rows) == len(hits) and [(r["key"], r["reason"], want[r["key"]]) for r in rows if r["reason"] != want[r["key"]]] == []
    assert set(want.values()) == {"new", "duplicate", "licence_rejected", "unsuitable", "failed"}


def test_a_chain_and_empty_tables(spark):
    # each hit shares its title with the one before and its content with the one after: every second one goes in
    hits = [(k, f"t{k // 2}", f"b{(k + 1) // 2}", "CC0-1.0", "image/png", 900, 900, True, None) for k in range(9)]
    known = spark.createDataFrame([], "title string, source_id string")
    out = ingest.decided(spark.createDataFrame(hits, HIT).drop("reason"), known).collect()
    assert {r["key"]: r["reason"] for r in out} == by_loop(hits, [])
    assert ingest.decided(spark.createDataFrame([], HIT).drop("reason"), known).count() == 0
