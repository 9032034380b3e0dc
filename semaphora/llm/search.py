"""Ranked lexical search: the best documents for every item of a query set, by sort-based accumulation.

Items are cut into blocks of bounded text, which tasks write to the shared folder as sorted arrays (terms, and for each
term its items) and workers memory-map. Documents are read twice: once for the statistics of all of them, once for
scores. A task takes its documents in batches: it looks their terms up, concatenates the arrays of (item, document,
impact) that they match, radix-sorts the packed keys and sums runs of equal keys. Of each item a heap keeps the best so
far, so a task hands on as many rows as results may have, however many documents match.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batches, mapped, mounted, saved, shared_dir, texts_of, written

#: What separates terms: all of ASCII but digits and letters.
BETWEEN = bytes(b for b in range(128) if not chr(b).isalnum())
#: Item text in one block, in bytes, on the average: what a task holds of the items.
BLOCK_BYTES = 4 << 20
#: Matches that a task holds at once.
MATCHES_AT_ONCE = 1 << 20
_LAST = (1 << 63) - 1
_KINDS = [np.uint64, np.int64, np.int64, np.int32, np.int64]


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of unsigned keys below 2 ** bits: 16 bits a pass, which numpy sorts by their digits."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def summed(keys: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = radix_order(keys, bits)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal groups."""
    new = np.concatenate([[True], groups[1:] != groups[:-1]])[: len(groups)]
    return np.arange(len(groups)) - np.maximum.accumulate(np.where(new, np.arange(len(groups)), 0))


def _item_arrays(texts: list[bytes]) -> list[np.ndarray]:
    """Of items: term hashes in order, bytes of each term, where each term's items begin, items, and how often."""
    h, counts, start, end, _ = Words(BETWEEN).spans(texts)
    item = np.repeat(np.arange(len(texts)), counts)
    terms, first, which = np.unique(h, return_index=True, return_inverse=True)
    key, often = np.unique(which.astype(np.int64) * max(1, len(texts)) + item, return_counts=True)
    term, item = np.divmod(key, max(1, len(texts)))
    begins = np.searchsorted(term, np.arange(len(terms) + 1))
    return [terms, (end - start)[first], begins, item.astype(np.int32), often.astype(np.int64)]


@dataclass
class _Build:
    """Writes a block of items: its arrays for the workers; returns its items by number."""

    folder: str

    def __call__(self, key: tuple, block: pa.Table) -> pa.Table:
        b = key[0].as_py()
        block = block.sort_by([("item_id", "ascending"), ("text", "ascending")])
        saved(f"{self.folder}/{b:06d}", *_item_arrays(block.column("text").to_pylist()))
        return pa.table({"block": pa.array([b] * len(block), pa.int32()), "item": pa.array(range(len(block)), pa.int32()), "item_id": block.column("item_id").cast(pa.int64())})


@dataclass
class Items:
    """The blocks of a query set in folder; a block is mapped when a worker first needs it."""

    folder: str
    blocks: list[int]
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def block(self, b: int) -> list[np.ndarray]:
        if b not in self._open:
            self._open[b] = mapped(f"{self.folder}/{b:06d}", _KINDS)
        return self._open[b]

    def weights(self, b: int) -> np.ndarray:
        if ("w", b) not in self._open:
            self._open["w", b] = mapped(f"{self.folder}/w{b:06d}", [np.int64])[0]
        return self._open["w", b]


def _found(block: list[np.ndarray], h: np.ndarray, counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of a batch's words that a block's items hold, by hash and length."""
    terms, lengths = block[0], block[1]
    at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
    hit = np.flatnonzero((terms[at] == h) & (lengths[at] == size)) if len(terms) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)[hit]
    keys = doc.astype(np.uint64) * np.uint64(max(1, len(terms))) + at[hit].astype(np.uint64)
    keys, often = summed(keys, np.ones(len(keys), np.int64), int(len(counts) * max(1, len(terms))).bit_length())
    doc, term = np.divmod(keys.astype(np.int64), max(1, len(terms)))
    return doc, term, often


@dataclass
class _Count:
    """Statistics of a part of the documents: rows (block, term, n), n the documents that hold a term; and in block -1
    the documents with a term (term 0) and all terms (term 1)."""

    items: Items

    def __call__(self, arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, docs, total = Words(BETWEEN), 0, 0
        held = {b: np.zeros(len(self.items.block(b)[0]), np.int64) for b in self.items.blocks}
        for batch in batches(arrow):
            h, counts, start, end, _ = words.spans(texts_of(batch, "text"))
            docs, total = docs + int((counts > 0).sum()), total + int(counts.sum())
            for b in self.items.blocks:
                _, term, _ = _found(self.items.block(b), h, counts, end - start)
                held[b] += np.bincount(term, minlength=len(held[b]))
        yield self._rows(-1, np.array([0, 1]), np.array([docs, total]))
        for b, n in held.items():
            yield self._rows(b, np.flatnonzero(n), n[n > 0])

    @staticmethod
    def _rows(b: int, term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(term), b), pa.int32()), "term": pa.array(term, pa.int64()), "n": pa.array(n, pa.int64())})


@dataclass
class _Weigh:
    """Writes the weights of a block's terms; a term that no document holds has weight 0."""

    items: Items

    def __call__(self, key: tuple, block: pa.Table) -> pa.Table:
        b = key[0].as_py()
        w, term = np.zeros(len(self.items.block(b)[0]), np.int64), block.column("term").to_numpy()
        w[term[term >= 0]] = block.column("w").to_numpy()[term >= 0]
        saved(f"{self.items.folder}/w{b:06d}", w)
        return pa.table({"block": pa.array([b], pa.int32())})


def dampening(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A document's m by its number of terms: 100 - 75 + (75 * n * N) div L, exact beyond 64 bits too."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        return np.array([25 + 75 * x * docs // total for x in n.tolist()], dtype=np.int64)
    return 25 + (75 * n.astype(np.int64) * docs) // max(1, total)


@dataclass
class _Rank:
    """The k best documents of a part for each item of a block: rows (block, item, doc_id, score)."""

    items: Items
    b: int
    docs: int
    total: int
    k: int

    def __call__(self, arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (terms, _, begins, item, often) = Words(BETWEEN), self.items.block(self.b)
        w = self.items.weights(self.b)
        n_items = int(item.max()) + 1 if len(item) else 0
        heaps: list[list[tuple]] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)  # what a document has to score at least to come in
        for batch in batches(arrow):
            ids = texts_of(batch, "doc_id")
            by_id = np.array([_LAST if x is None else x for x in ids], np.int64)
            h, counts, start, end, _ = words.spans(texts_of(batch, "text"))
            doc, term, tf = _found(self.items.block(self.b), h, counts, end - start)
            m = dampening(counts, self.docs, self.total)
            impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            some = np.flatnonzero(impact > 0)
            doc, term, impact = doc[some], term[some], impact[some]
            many = begins[term + 1] - begins[term]
            upto = np.cumsum(many)
            lo = 0
            while lo < len(doc):  # whole documents, as many as fit
                hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MATCHES_AT_ONCE, "right"))
                hi = len(doc) if hi >= len(doc) else max(int(np.searchsorted(doc, doc[hi])), int(np.searchsorted(doc, doc[lo], "right")))
                part, n = slice(lo, hi), many[lo:hi]
                each = np.repeat(begins[term[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                keys = item[each].astype(np.uint64) * np.uint64(len(ids)) + np.repeat(doc[part], n).astype(np.uint64)
                keys, scores = summed(keys, np.repeat(impact[part], n) * often[each], (n_items * len(ids)).bit_length())
                to, of = np.divmod(keys.astype(np.int64), len(ids))
                better = np.flatnonzero(scores >= least[to])
                better = better[np.lexsort((by_id[of[better]], -scores[better], to[better]))]
                better = better[_places(to[better]) < self.k]
                for i, d, s in zip(to[better].tolist(), of[better].tolist(), scores[better].tolist(), strict=True):
                    heap, entry = heaps[i], (s, ids[d] is not None, -(ids[d] or 0))
                    if len(heap) < self.k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == self.k:
                        least[i] = heap[0][0]
                lo = hi
        rows = [(i, -e[2] if e[1] else None, e[0]) for i, heap in enumerate(heaps) for e in heap]
        i, d, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"block": pa.array([self.b] * len(rows), pa.int32()), "item": pa.array(i, pa.int32()), "doc_id": pa.array(d, pa.int64()), "score": pa.array(s, pa.int64())})


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item (item_id, text) the k documents (doc_id, text) of the highest score
    above 0, all if there are fewer; equal scores by ascending doc_id.

    Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII in whole texts, A-Z lower-cased. N:
    documents with a term, L: all their terms, n: a document's, df: documents that hold a term, tf: its occurrences in
    one. A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a document's m is 25 + (75 * n * N) div L; a score is
    the sum of w * ((10^9 * tf) div (1000 * tf + 8 * m)) over an item's terms, repeats included.

    Null texts have no terms. Repeated rows are documents of their own; a null doc_id comes last among equal scores.
    Items of one id but other texts are ranked each; repeated ones count once. Both ids are integers. Empty tables give
    no rows; other columns are not looked at. Terms are told by 64-bit hash and length."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    cut = F.pmod(F.xxhash64("item_id", "text"), F.lit(size // block_bytes + 1)).cast("int").alias("block")
    folder = mounted(f"{shared_dir(spark)}/semaphora/search-{uuid.uuid4().hex}")
    build = _Build(folder)
    names = items.select(cut, "item_id", F.col("text").cast("binary").alias("text")).groupBy("block").applyInArrow(lambda key, block: build(key, block), "block int, item int, item_id long")
    names = written(names, "search-items")
    blocks = [r["block"] for r in names.select("block").distinct().orderBy("block").collect()]
    index = Items(folder, blocks)
    counts = docs.mapInArrow(_Count(index), "block int, term long, n long").groupBy("block", "term").agg(F.sum("n").alias("n"))
    counts = written(counts, "search-counts")
    of_all = {r["term"]: r["n"] for r in counts.filter("block = -1").collect()}
    n_docs, total = of_all.get(0, 0), of_all.get(1, 0)
    weight = F.floor(F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("n") + 1.0)) * 1000.0).cast("long")
    every = names.select("block", F.lit(-1).cast("long").alias("term"), F.lit(0).cast("long").alias("w")).distinct()  # also of blocks that no document meets
    weights = counts.filter("block >= 0").select("block", "term", weight.alias("w")).unionByName(every)
    weigh = _Weigh(index)
    weights.groupBy("block").applyInArrow(lambda key, block: weigh(key, block), "block int").collect()
    found = None
    for b in blocks:
        part = docs.mapInArrow(_Rank(index, b, n_docs, total, k), "block int, item int, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    w = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    named = names.select(F.col("block").alias("_b"), F.col("item").alias("_i"), "item_id")
    return best.join(named, (F.col("block") == F.col("_b")) & (F.col("item") == F.col("_i"))).select("item_id", "rank", "doc_id", "score")
