"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared runs of min_match tokens, found by Karp-Rabin hashes. For each
such pair the longest match of unmarked tokens is marked, again and again, until none of min_match tokens is left
(greedy string tiling; the tiles may stand in any order). An item's coverage is the share of its tokens under
tiles; a document that covers enough of an item is contaminated by it.

The benchmark's hashes are written in blocks of sorted arrays to the shared folder, which workers memory-map: nothing
of it passes the driver, a task holds what it touches, and documents are read and hashed once however many blocks
there are.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, SPACE, Words, batches, docs_of, mapped, mounted, saved, shared_dir, texts_of, windows

BETWEEN = SPACE + PUNCTUATION
#: Benchmark text in one block, in bytes, on the average: what a task holds to hash it.
BLOCK_BYTES = 16 << 20
#: Seeds that a task holds at once before it joins those of one diagonal to matches.
SEEDS_AT_ONCE = 1 << 21
_FILTER = 1 << 20
_KINDS = [np.int64, np.int64, np.int64, np.int64, np.uint64, np.int32, np.int32, np.bool_]


def _seed_arrays(ids: list[int], texts: list[bytes], min_match: int) -> list[np.ndarray]:
    """ids and token counts of items, and their runs of min_match tokens by hash: the lengths of runs that occur (an
    item that is shorter is a run of its own length), where each length's runs end, and hashes (sorted by length),
    items, positions, and a bitmap of each length's hashes."""
    h, counts = Words(BETWEEN).of(texts)
    items = np.split(h, np.cumsum(counts)[:-1])
    lengths = sorted({min(min_match, len(i)) for i in items} - {0})
    keys, item, at, bits = [], [], [], []
    for n in lengths:
        runs = [(windows(i, n), k) for k, i in enumerate(items) if min(min_match, len(i)) == n]
        key = np.concatenate([r for r, _ in runs])
        order = np.argsort(key, kind="stable")
        keys.append(key[order])
        item.append(np.concatenate([np.full(len(r), k) for r, k in runs])[order])
        at.append(np.concatenate([np.arange(len(r)) for r, _ in runs])[order])
        bits.append(np.zeros(_FILTER, dtype=bool))
        bits[-1][(key & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    found = [ids, counts, lengths, np.cumsum([len(k) for k in keys])]
    return [*(np.array(x, dtype=np.int64) for x in found), *(join(x, kind) for x, kind in zip((keys, item, at, bits), _KINDS[4:], strict=True))]


@dataclass
class Matches:
    """Runs of seeds on one diagonal, by document (of a batch), item (of a block) and diagonal: arrays of equal length."""

    doc: np.ndarray
    item: np.ndarray
    d: np.ndarray
    i: np.ndarray
    size: np.ndarray
    least: np.ndarray


def _on_diagonals(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, size: np.ndarray, least: np.ndarray) -> Matches:
    """Matches joined where one goes on as the other does, overlapping by all but one of least tokens or more."""
    order = np.lexsort((d, d - i, item, doc))
    doc, item, d, i, size, least = (x[order] for x in (doc, item, d, i, size, least))
    new = np.ones(len(d), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((d - i)[1:] != (d - i)[:-1]) | (d[1:] > d[:-1] + size[:-1] - least[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1 if len(d) else first
    return Matches(doc[first], item[first], d[first], i[first], d[last] + size[last] - d[first], least[first])


@dataclass
class Seeds:
    """The blocks of a benchmark in folder; a block is mapped when a worker first needs it."""

    folder: str
    blocks: list[int]
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def block(self, k: int) -> list[np.ndarray]:
        if k not in self._open:
            self._open[k] = mapped(f"{self.folder}/{k:06d}", _KINDS)
        return self._open[k]

    def matches(self, k: int, h: np.ndarray, counts: np.ndarray) -> Matches:
        """The matches of block k with a batch of documents (hashes of words, words of each document)."""
        _, _, lengths, cuts, keys, items, ats, bits = self.block(k)
        ends, starts = np.cumsum(counts), np.cumsum(counts) - counts
        none = np.zeros(0, np.int64)
        found, held = [(none,) * 6], 0
        for j, n in enumerate(lengths.tolist()):
            x, y = int(cuts[j - 1]) if j else 0, int(cuts[j])
            key, w = keys[x:y], windows(h, n)
            maybe = np.flatnonzero(bits[j * _FILTER : (j + 1) * _FILTER][(w & np.uint64(_FILTER - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(key, w[maybe], "left"), np.searchsorted(key, w[maybe], "right")
            doc = np.searchsorted(ends, maybe, "right")
            inside = (hi > lo) & (maybe + n <= ends[np.minimum(doc, len(ends) - 1)])
            maybe, doc, lo, many = maybe[inside], doc[inside], lo[inside], (hi - lo)[inside]
            total = np.cumsum(many)
            at = 0
            while at < len(many):  # many equal runs on both sides make many seeds: so many at once, joined to matches
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SEEDS_AT_ONCE, "right")))
                part, m = slice(at, upto), many[at:upto]
                each = np.repeat(lo[part] - np.cumsum(m) + m, m) + np.arange(m.sum()) + x
                d, i = np.repeat(maybe[part] - starts[doc[part]], m), ats[each].astype(np.int64)
                runs = _on_diagonals(np.repeat(doc[part], m), items[each].astype(np.int64), d, i, np.full(len(d), n), np.full(len(d), n))
                found.append((runs.doc, runs.item, runs.d, runs.i, runs.size, runs.least))
                held += len(runs.doc)
                at = upto
        return _on_diagonals(*(np.concatenate(c) for c in zip(*found, strict=True)))


def tiles(matches: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping tiles (document position, item position, length), longest first.

    matches: where runs of n tokens or more agree, as long as they can be. The longest is marked, and what later
    matches lose to marked tokens is cut off, until no match of n tokens is left. Of equally long matches the one that
    comes first in the document, then in the item, is marked."""
    if len(matches) == 1:
        return matches
    heap = [(-size, d, i) for d, i, size in matches]
    heapq.heapify(heap)
    in_doc = np.zeros(max((d + size for d, _, size in matches), default=0), dtype=bool)
    in_item = np.zeros(max((i + size for _, i, size in matches), default=0), dtype=bool)
    done = []
    while heap:
        size, d, i = heapq.heappop(heap)
        size = -size
        taken = in_doc[d : d + size] | in_item[i : i + size]
        if not taken.any():
            in_doc[d : d + size] = True
            in_item[i : i + size] = True
            done.append((d, i, size))
            continue
        turn = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True]))))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if b - a >= n:
                heapq.heappush(heap, (a - b, d + a, i + a))
    return done


def seeds(benchmark: DataFrame, min_match: int = 5, block_bytes: int = BLOCK_BYTES) -> Seeds:
    """Writes the hashes of a benchmark (item_id, text) to the shared folder: items are dealt by hash to as many blocks
    as their measured size asks for; a task holds the items of a block. Rows with nulls don't count, equal rows once."""
    spark = benchmark.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("text")).dropDuplicates(["item_id", "text"])
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-2 * total // block_bytes))
    folder = mounted(f"{shared_dir(spark)}/semaphora/benchmark-{uuid.uuid4().hex}")

    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in it:
            for block, item, text in zip(*(texts_of(batch, c) for c in ("block", "item_id", "text")), strict=True):
                held.setdefault(block, []).append((item, text))
        for block, rows in held.items():
            rows.sort()
            saved(f"{folder}/{block:06d}", *_seed_arrays([r[0] for r in rows], [r[1] for r in rows], min_match))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32())], ["block"])

    rows = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int")).repartitionById(n_blocks, F.col("block"))
    return Seeds(folder, sorted(r["block"] for r in rows.select("block", "item_id", "text").mapInArrow(write, "block int").collect()))


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, least: float = 0.6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id) where a document covers at least least of an item's tokens: with coverage,
    matched_tokens, item_tokens and n_tiles.

    Tokens are runs without ASCII white space and punctuation, A-Z lower-cased. The benchmark's size is measured, and
    it is written in blocks of block_bytes on the average (see seeds()); ids are numbers. Null or empty texts and null
    ids on either side give no pair; repeated rows of an item or a document give their pairs once each time they stand
    in docs."""
    return docs_of(docs.filter("doc_id is not null")).mapInArrow(_tiled(seeds(benchmark, min_match, block_bytes), least), PAIRS)


PAIRS = "doc_id long, item_id long, coverage double, matched_tokens long, item_tokens long, n_tiles long"


def _tiled(found: Seeds, least: float):
    def pairs(block: int, h: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        item_ids, sizes = found.block(block)[:2]
        m = found.matches(block, h, counts)
        if not len(m.doc):
            return
        first = np.flatnonzero(np.concatenate(([True], (m.doc[1:] != m.doc[:-1]) | (m.item[1:] != m.item[:-1]))))
        # the matches of a pair can't cover more than they hold: most pairs are settled by that
        most = np.add.reduceat(m.size, first)
        for k in np.flatnonzero(most >= least * sizes[m.item[first]]).tolist():
            a, b = int(first[k]), int(first[k + 1]) if k + 1 < len(first) else len(m.doc)
            marked = tiles(list(zip(m.d[a:b].tolist(), m.i[a:b].tolist(), m.size[a:b].tolist(), strict=True)), int(m.least[a]))
            size, covered = int(sizes[m.item[a]]), sum(t[2] for t in marked)
            if covered >= least * size:
                yield int(m.doc[a]), int(item_ids[m.item[a]]), covered / size, covered, size, len(marked)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(BETWEEN)
        for batch in batches(it):
            ids, texts = texts_of(batch, "doc_id"), words.of(texts_of(batch, "text"))
            rows = sorted(p for block in found.blocks for p in pairs(block, *texts))
            columns = [[ids[r[0]] for r in rows], *([r[k] for r in rows] for k in range(1, 6))]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PAIRS.split(", ")])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, least: float = 0.6) -> DataFrame:
    """docs without those that are contaminated by an item of benchmark; all columns stay.

    Null and empty texts and null ids stay. Rows of one doc_id are one document: if one of them is contaminated, all go."""
    gone = contamination(docs, benchmark, min_match, least).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
