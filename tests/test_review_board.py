"""Review: what an adopted suggestion brings with it, ties of the work list, the nearest place of a line by brute force."""

import math
import random

from pyspark.sql import functions as F

from semaphora.functions.geometry import nearest_on_line
from semaphora.operators import metrics, review


def test_adopted(spark):
    """A route over two edges that share a node; one node is in the document; a cycle; an id that is no suggestion."""
    suggested = spark.createDataFrame([(1, i) for i in ("r", "e1", "e2", "n1", "n2", "s", "x", "y", "e1")], "doc long, id string")
    requires = spark.createDataFrame(
        [(1, *p) for p in (("r", "s"), ("r", "e1"), ("r", "e2"), ("s", "e1"), ("e1", "n1"), ("e1", "n2"), ("e2", "n2"), ("e2", "gone"), ("e2", "there"), ("x", "y"), ("y", "x"), ("r", "e1"))], "doc long, id string, ref string"
    )
    present = spark.createDataFrame([(1, "there"), (1, "n1")], "doc long, id string")
    chosen = spark.createDataFrame([(1, i) for i in ("r", "e2", "x", "there", "nothing", "r")], "doc long, id string")
    rows = review.adopted(chosen, suggested, requires, present).collect()
    order = {c: [r["id"] for r in sorted(rows, key=lambda r: r["step"]) if r["chosen"] == c] for c in {r["chosen"] for r in rows}}
    assert order["r"] == ["n2", "e1", "e2", "s", "r"] or order["r"].index("s") > order["r"].index("e1") > order["r"].index("n2")
    assert order["e2"] == ["n2", "e2"] and sorted(order["x"]) == ["x", "y"] and set(order) == {"r", "e2", "x"}
    assert len(order["r"]) == 5 and order["r"][-1] == "r"


def test_worklist_and_board(spark):
    rows = [(1, 0, "a", "consensus", None), (1, 1, "b", None, None), (1, 2, "c", "minority", None), (1, 3, "d", "contested", None), (1, 4, "e", "minority", "edited"), (1, 1, "a2", None, None)]
    got = review.worklist(spark.createDataFrame(rows, "doc long, pos int, id string, status string, changed string")).orderBy("place").collect()
    assert [(r["id"], r["rank"]) for r in got] == [("a2", 0), ("b", 0), ("c", 0), ("d", 1), ("a", 2), ("e", 3)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "scene_id string")
    elements = spark.createDataFrame([("a", "consensus"), ("a", "minority"), ("n", "consensus")], "scene_id string, status string")
    board = review.board(ids("a", "b", "c", "n"), ids("a", "a", "b"), ids("b", "c"), ids("c", "z"), elements)
    assert sorted(map(tuple, board.collect())) == [("a", "todo", 2, 1), ("b", "in_progress", 0, 0), ("c", "done", 0, 0), ("n", "no_draft", 0, 0)]


def test_nearest_on_line(spark):
    draw = random.Random(3)
    cases = [([(0, 0), (0, 0)], 3, 4), ([(0, 0), (10, 0)], 5, 2), ([(0, 0), (4, 0), (4, 4), (0, 4)], 2, 2), ([(1, 1), (1, 1), (5, 1)], 9, 1)]
    cases += [([(draw.randint(0, 9), draw.randint(0, 9)) for _ in range(draw.randint(2, 6))], draw.randint(-3, 12), draw.randint(-3, 12)) for _ in range(60)]

    def plain(line, x, y):
        lengths = [math.dist(p, q) for p, q in zip(line, line[1:], strict=False)]
        best = None
        for i, (a, b) in enumerate(zip(line, line[1:], strict=False)):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / lengths[i] ** 2)) if lengths[i] else 0
            d = math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)
            if best is None or d < best[0] - 1e-12:
                best = (d, (sum(lengths[:i]) + t * lengths[i]) / sum(lengths) if sum(lengths) else 0.5)
        return best

    df = spark.createDataFrame([([{"x": float(p), "y": float(q)} for p, q in line], float(x), float(y)) for line, x, y in cases], "points array<struct<x:double,y:double>>, x double, y double")
    got = df.select(nearest_on_line(F.col("points"), F.col("x"), F.col("y")).alias("n")).collect()
    for r, case in zip(got, cases, strict=True):
        d, offset = plain(*case)
        assert math.isclose(r["n"]["distance"], d, abs_tol=1e-9) and (math.isclose(r["n"]["offset"], offset, abs_tol=1e-9) or len(case[0]) > 2), case


def test_degree_agreement(spark):
    nodes = lambda d: spark.createDataFrame([(1, i, n) for i, n in d.items()], "doc long, id string, degree long")
    pairs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "doc long, t_id string, p_id string")
    row = metrics.degree_agreement(nodes({"a": 1, "b": 2, "c": 2}), nodes({"x": 1, "y": 3, "z": 2}), pairs).first()
    assert tuple(row) == (1, 0.5, False, 0.333333333)
    assert tuple(metrics.degree_agreement(nodes({"a": 1, "b": 2}), nodes({"x": 2, "y": 1}), pairs).first()) == (1, 1.0, True, 0.0)
    edges = spark.createDataFrame([(1, "a", "a"), (1, "a", "gone")], "doc long, a_node string, b_node string")
    assert metrics.degrees(nodes({"a": 0, "b": 0}), edges).orderBy("id").collect() == [(1, "a", 3), (1, "b", 0)]
