"""Quality by ordinal cumulative-link regression on graded ratings.

A text becomes a sparse vector of hashed words and hashed facts about its form. One weight vector gives a latent
quality; ordered thresholds cut it into grades: P(grade > k) = 1 / (1 + exp(threshold_k - quality)). Fitted by
likelihood in Spark: shards of the rated rows each improve the parameters, their means start the next round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, carried, mixed, texts_of, written

SIZE = 1 << 16
#: Shards of the rated rows, rounds of averaging, passes of a shard over its rows in a round.
SHARDS, ROUNDS, PASSES = 8, 6, 2
MAX_ROWS = 20_000
_FORM = 24
# classes of bytes: other, white space, lower case, upper case, digits, punctuation, of longer characters
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(b" \t\n\x0b\x0c\r")] = 1
_CLASS[list(range(97, 123))] = 2
_CLASS[list(range(65, 91))] = 3
_CLASS[list(range(48, 58))] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5
_CLASS[128:] = 6


def _slot(kind: int, value: int) -> int:
    return int(mixed(np.array([kind << 32 | value + 1], dtype=np.uint64))[0] % np.uint64(SIZE))


_SLOTS = np.array([[_slot(kind, value) for value in range(12)] for kind in range(_FORM)])


def _form(text: bytes, h: np.ndarray) -> list[int]:
    """Slots of facts about a text's form: shares of classes, of repeated words and lines, lengths; in steps of a tenth."""
    n, words = max(len(text), 1), max(len(h), 1)
    share = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7) / n
    lines = text.split(b"\n")
    distinct = len(np.unique(h)) / words
    follows = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    facts = [*share[1:], distinct, follows, len(set(lines)) / len(lines), share[3] / max(share[2] + share[3], 1e-9), min(n / words / 20, 1.0), min(np.log10(words) / 5, 1.0)]
    return [int(_SLOTS[k, min(int(f * 10), 10)]) for k, f in enumerate(facts)]


def features(texts: list[bytes | None], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text: words by log count, to length 1, and facts about form at 0.5 each."""
    h, counts = words.of(texts)
    at = 0
    for text, c in zip(texts, counts.tolist(), strict=True):
        own = h[at : at + c]
        at += c
        slot, n = np.unique(own % np.uint64(SIZE), return_counts=True)
        value = np.log1p(n)
        value /= max(float(np.sqrt((value * value).sum())), 1e-9)
        form = np.array(_form(text or b"", own), dtype=np.int64)
        yield np.concatenate((slot.astype(np.int64), form)), np.concatenate((value, np.full(len(form), 0.5)))


@dataclass
class Ordinal:
    """weights shared by all grades, thresholds in order; grades 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(grade > k), a row for each text and a column for each k."""
        quality = np.array([float(self.weights[s] @ v) for s, v in rows])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - quality[:, None], -30, 30)))


def _featured(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in it:
        rows = list(features(texts_of(batch, "text"), words))
        given = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "place", "grade")]
        slots, vals = pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([*given, slots, vals], ["shard", "place", "grade", "slots", "vals"])


def _sigma(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(q: float, grade: int, thresholds: np.ndarray) -> tuple[float, dict[int, float]]:
    """Of the negative log-likelihood of a grade at quality q: the derivatives by q and by the thresholds around it."""
    # P(grade) = hi - lo with hi = sigma(t_grade - q), lo = sigma(t_{grade-1} - q)
    hi = _sigma(thresholds[grade] - q) if grade < len(thresholds) else 1.0
    lo = _sigma(thresholds[grade - 1] - q) if grade > 0 else 0.0
    p = max(hi - lo, 1e-9)
    around = {grade: -hi * (1 - hi) / p, grade - 1: lo * (1 - lo) / p}
    return (hi * (1 - hi) - lo * (1 - lo)) / p, {k: d for k, d in around.items() if 0 <= k < len(thresholds)}


def _improved(weights: np.ndarray, thresholds: np.ndarray, round_: int, decay: float):
    """One shard's passes: stochastic gradients of the likelihood, with a step for each parameter that shrinks (Adagrad)."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in it:
            slots, vals = (batch.column(batch.schema.get_field_index(c)) for c in ("slots", "vals"))
            given = zip(texts_of(batch, "place"), texts_of(batch, "grade"), strict=True)
            rows += [(at, g, slots[i].values.to_numpy(), vals[i].values.to_numpy().astype(np.float64)) for i, (at, g) in enumerate(given)]
        # in the same order whatever order the rows were fetched in
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        w, t = weights.copy(), thresholds.copy()
        seen, seen_t = np.full(SIZE, 1e-2), np.full(len(t), 1e-2)
        draw = np.random.default_rng(round_)
        for _ in range(PASSES):
            for i in draw.permutation(len(rows)):
                _, g, s, v = rows[i]
                dq, around = gradients(float(w[s] @ v), g, t)
                grad = dq * v + decay * w[s]
                seen[s] += grad * grad
                w[s] -= 0.3 * grad / np.sqrt(seen[s])
                for k, d in around.items():
                    seen_t[k] += d * d
                    t[k] -= 0.3 * d / np.sqrt(seen_t[k])
                t.sort()
        values = [pa.array([len(rows)], pa.int64()), pa.array([w.tobytes()], pa.binary()), pa.array([t.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(values, ["n", "w", "t"])

    return run


def fit(rated: DataFrame, n_grades: int, max_rows: int = MAX_ROWS, decay: float = 1e-4) -> Ordinal:
    """Fits on rows (doc_id, text, grade), grades 0 to n_grades-1; rows with another grade, a null grade or a null id
    don't count. A null text counts as empty.

    At most about max_rows rows are used, those of the least hash of doc_id (the documented bound of a fit on
    labelled rows). Without rows all weights are 0 and every grade is as likely. A shard's rows are taken in an order
    of their own, so that a task that runs again gives the same."""
    rated = rated.filter(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull()).select("doc_id", "text", "grade")
    n = rated.count()
    if n > max_rows:
        rated = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard")
    rows = rated.select(shard, F.xxhash64("doc_id", "text").alias("place"), F.col("grade").cast("int").alias("grade"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionById(SHARDS, "shard").mapInArrow(_featured, "shard int, place long, grade int, slots array<int>, vals array<float>")
    rows = written(rows, "rated")
    weights, thresholds = np.zeros(SIZE), np.log((np.arange(1, n_grades)) / (n_grades - np.arange(1, n_grades)))
    for k in range(ROUNDS if n else 0):
        tried = rows.repartitionById(SHARDS, "shard").mapInArrow(_improved(weights, thresholds, k, decay), "n long, w binary, t binary")
        parts = tried.filter("n > 0").collect()  # a row for each shard
        total = sum(p["n"] for p in parts)
        weights = sum(np.frombuffer(p["w"]) * (p["n"] / total) for p in parts)
        thresholds = np.sort(sum(np.frombuffer(p["t"]) * (p["n"] / total) for p in parts))
    return Ordinal(weights, thresholds)


def graded(docs: DataFrame, model: Ordinal, *keep: str) -> DataFrame:
    """doc_id, the columns keep, expected_grade and tail (array: P(grade > 0), P(grade > 1), ...) for every document.

    Whole texts; a null text counts as empty, repeated rows are graded alike, null ids pass through. A kept column
    that is named like an output comes out with _in after its name."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in it:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                tail = model.above(features(texts_of(batch, "_text"), words))
                out = [pa.array(tail.sum(axis=1)), pa.array(list(tail), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "expected_grade", "tail"])

    rows, schema = carried(docs, keep, ["expected_grade", "tail"])
    return rows.mapInArrow(run, f"{schema}, expected_grade double, tail array<double>")


def selected(docs: DataFrame, model: Ordinal, grade: int = 1, least: float = 0.5) -> DataFrame:
    """docs whose grade reaches grade with a probability of least at least; all columns stay."""
    gone = graded(docs, model).filter(F.get("tail", F.lit(grade - 1)) < least).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
