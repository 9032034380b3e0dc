"""Search against plain scores of all pairs, and the radix sums against sorted ones."""

import math
import re
from collections import Counter

import numpy as np

from semaphora.llm import search

from .helpers import empty, hard, hard_rows, lowered


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))


def plain(docs, items, k=10):
    """docs: [(doc_id, text)], items: [(item_id, text)]; rows (item_id, rank, doc_id, score)."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n = {i: sum(b.values()) for i, (_, b) in enumerate(bags)}
    some, total = sum(1 for x in n.values() if x), sum(n.values())
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, (d, b) in enumerate(bags):
            m = 25 + 75 * n[i] * some // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return out


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_hard_rows(spark):
    items = [(1, "a b c the end é"), (1, "a b c the end é"), (1, "word one"), (2, None), (3, ""), (None, "漢字 WORD line line line"), (4, "nowhere"), (5, "null id words a")]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = plain([(r[0], r[1]) for r in hard_rows()], items)
    same(search.ranked(hard(spark), asked).collect(), want)
    same(search.ranked(hard(spark).repartition(6), asked, block_bytes=8).collect(), want)  # a block an item
    same(search.ranked(hard(spark), asked, k=1).collect(), plain([(r[0], r[1]) for r in hard_rows()], items, 1))


def test_many_ties(spark, monkeypatch):
    """Thousands of equal documents: the smallest ids, whatever order they come in; matches cut into small parts."""
    docs = [(i * 7919 % 3000, "same words in each" if i % 3 else "other words each time") for i in range(3000)]
    items = [(1, "same each"), (2, "words"), (3, "other other time")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    same(search.ranked(df, spark.createDataFrame(items, "item_id long, text string")).collect(), plain(docs, items))


def test_table(spark, sf):
    from semaphora.llm.queries import search_query

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(search_query(spark, sf).collect(), plain(docs, items))


def test_empty(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(empty(spark), items).collect() == []
    assert search.ranked(hard(spark), items.limit(0)).collect() == []


def test_sums():
    rng = np.random.default_rng(1)
    for bits in (1, 15, 17, 40):
        keys = rng.integers(0, 1 << bits, 5000, dtype=np.uint64)
        values = rng.integers(0, 1000, 5000)
        got = search.summed(keys, values, bits)
        want = Counter()
        for key, v in zip(keys.tolist(), values.tolist(), strict=True):
            want[key] += v
        assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want
        assert (np.diff(got[0].astype(np.int64)) > 0).all()


def test_dampening_beyond_64_bits():
    n, docs, total = np.array([10**7, 0, 3]), 10**12, 10**15
    assert search.dampening(n, docs, total).tolist() == [25 + 75 * int(x) * docs // total for x in n]
