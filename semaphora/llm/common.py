"""Helpers that several training-data operators share."""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import removed, shared_dir, written

__all__ = ["removed", "shared_dir", "written"]
MASK64 = (1 << 64) - 1
WORDS = r"[^\x20\x09-\x0D]+"


def kept_as(keep: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """The names under which the columns keep come out: their own, but with _in after one that an output has taken."""
    out: dict[str, str] = {}
    for c in dict.fromkeys(keep):
        name = c
        while name in {*taken, *out.values()} or name != c and name in keep:
            name += "_in"
        out[c] = name
    return out


def carried(docs: DataFrame, keep: Iterable[str], outputs: list[str]) -> tuple[DataFrame, str]:
    """docs as doc_id, the columns keep under free names, and the text's bytes as the last column _text; and the
    schema (as DDL) of all but the text."""
    names = kept_as(keep, ["doc_id", "_text", *outputs])
    rows = docs.select("doc_id", *(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col("text").cast("binary").alias("_text"))
    return rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's text modulo n: the fold of a document."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")), F.lit(n))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n successive words (h: their hashes), in order; none if there are fewer words."""
    if len(h) < n:
        return h[:0]
    acc = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + mixed(h[i : len(h) - n + 1 + i] + np.uint64(i))
    return mixed(acc)


SPACE = b" \t\n\x0b\x0c\r"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Words:
    """Hashes the words of texts, a batch at a time: words are runs without the bytes of between, A-Z lower-cased."""

    def __init__(self, between: bytes = SPACE):
        self._between = np.zeros(256, dtype=bool)
        self._between[list(between)] = True
        self._powers, self._inverse = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _grown(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(n, 1 << 21)
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any parts of the joined text of the last spans(); of a whole word, its hash."""
        return mixed((self._total[end] - self._total[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def spans(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(hashes, word counts of the texts, starts, ends, the joined text): a word's hash depends on its bytes alone."""
        joined = b"\n".join(t or b"" for t in texts).lower()
        raw = np.frombuffer(joined, dtype=np.uint8)
        self._grown(len(raw) + 1)
        word = np.zeros(len(raw) + 2, dtype=np.int8)
        word[1:-1] = ~self._between[raw]
        turn = np.diff(word)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * self._powers[: len(raw)], out=total[1:])
        self._total = total
        h = self.parts(start, end)
        sizes = np.fromiter((len(t or b"") for t in texts), dtype=np.int64, count=len(texts))
        last = np.cumsum(sizes + 1)
        counts = np.diff(np.searchsorted(start, last), prepend=0)
        return h, counts, start, end, joined

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        h, counts, *_ = self.spans(texts)
        return h, counts


def shingle_sets(texts: list[bytes | None], n: int, words: Words) -> Iterator[np.ndarray]:
    """For each text the set of its distinct n-word shingles as sorted 64-bit hashes.

    With fewer than n words the whole sequence is one shingle; without a word (or text) the set is empty."""
    h, counts = words.of(texts)
    every, at = windows(h, n), 0
    for c in counts.tolist():
        if c >= n:
            yield np.unique(every[at : at + c - n + 1])
        else:
            yield windows(h[at : at + c], c) if c else h[:0]
        at += c


def texts_of(batch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def docs_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as bytes, and more columns."""
    return df.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def batches(arrow: Iterable, rows: int = 512) -> Iterator:
    """The same batches in slices, so that what a slice gives stays small."""
    for batch in arrow:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mounted(folder: str) -> str:
    """The path of a new folder for files that workers memory-map."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the files are memory-mapped: mount {folder} and name the mounted folder in spark.checkpoint.dir")
    os.makedirs(url.path, exist_ok=True)
    return url.path


def saved(path: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other under their sizes. A repeated task puts the same bytes in place in one step."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(np.array([len(a) for a in arrays], dtype=np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes())
    os.replace(own, path)


def mapped(path: str, kinds: list) -> list[np.ndarray]:
    """The arrays of a file of saved(), mapped into memory. A missing file is an error."""
    with open(path, "rb") as f:  # the mapping holds no file open where Python allows that
        raw = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    sizes, at, out = np.frombuffer(raw, dtype=np.int64, count=len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected links (a, b): rows (v, label), label the smallest id reachable from v.

    Labels spread over links and jump along themselves (each node takes its label's label) until none changes;
    every round is written to the shared folder, and what only former rounds read is removed. Only a count reaches
    the driver. A hub's links, and the members of a giant component, are the large side of a join that adaptive
    execution splits; what follows is a minimum, folded before its shuffle."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name + "-links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label"))
    labels = written(labels, name)
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels.v == near.a).select("v", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        spread = written(spread, name)
        to = spread.select(F.col("v").alias("w"), F.col("label").alias("next"))
        jumped = spread.join(to, spread.label == to.w).select("v", F.least("label", "next").alias("label"), "old")
        jumped = written(jumped, name)
        changed = jumped.filter("label <> old").limit(1).count()
        removed(labels, spread)
        labels = jumped.select("v", "label")
        labels._written_to = jumped.__dict__.pop("_written_to")
        if not changed:
            removed(both)
            return labels
