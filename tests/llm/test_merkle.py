"""The manifest against a tree built in plain Python, and the traversal's memory."""

import hashlib
import zlib

import pytest

from semaphora.llm import merkle
from semaphora.llm.common import id_bucket

from .helpers import empty, hard, lowered

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def path(tree, i, arity):
    """(left, right) siblings of place i from the leaves up."""
    out = []
    for level in tree[:-1]:
        a = i - i % arity
        out.append((level[a:i], level[i + 1 : a + arity]))
        i //= arity
    return out


def plain(rows, arity=8):
    """What manifest() has to give, from whole trees held in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in order]
    top = levels([t[-1][0] for t in trees], arity) if trees else []
    out = []
    for k, g in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[k], i, arity) + path(top, k, arity)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf(r, None if r["text"] is None else lowered(r["text"])) if hit else own
            for left, right in steps:
                node = sha(*left, node, *right)
            proof = sha(*(x for left, right in steps for x in [*left, *right]))
            out.append((r["doc_id"], own, trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def manifest(docs, **shape):
    from pyspark.sql import functions as F

    low = merkle.row_digest([*(F.col(c) for c in COLUMNS[:-1]), F.translate("text", merkle.UPPER, merkle.UPPER.lower())])
    return merkle.manifest(docs, COLUMNS, now=F.when(id_bucket("doc_id", 3) == 0, low), shape=merkle.Shape(**shape))


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("h", [1, 2, 3])
@pytest.mark.parametrize("arity", [2, 3, 8])
def test_traversal(arity, h):
    for n in (1, 2, 7, 8, 9, 27, 63, 64, 65, 130):
        leaves = [f"{i}" for i in range(n)]
        tree = levels(leaves, arity)
        for up in (0, 2):  # in a tree of its own, and as the last block of a larger one
            walk = merkle.Traversal(leaves, len(tree) - 1 + up, arity, h)
            for i, p in enumerate(walk.paths()):
                want = [("".join(left), "".join(right)) for left, right in path(tree, i, arity)] + [("", "")] * up
                assert p == want
            stacked = -(-(len(tree) - 1 + up) // h)
            assert walk.held <= stacked * 3 * arity**h  # two subtrees a level, however many leaves


def test_tree_shapes(spark):
    rows = [dict(zip(COLUMNS, (i, "s", None if i % 3 == 0 else "x" if i % 3 == 1 else f"g{i % 7}", i, f"Text {i}"), strict=True)) for i in range(260)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    for shape in ({"arity": 2, "h": 1, "stacked": 2, "parts": 4}, {"arity": 8, "h": 1, "stacked": 1, "parts": 3}, {"arity": 3, "h": 2, "stacked": 2, "parts": 1}):
        got = [tuple(r) for r in manifest(docs, **shape).collect()]
        assert sorted(got, key=key) == sorted(plain(rows, shape["arity"]), key=key)


def test_hard_rows(spark):
    rows = [r.asDict() for r in hard(spark).collect()]
    got = [tuple(r) for r in manifest(hard(spark)).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_empty(spark):
    assert manifest(empty(spark)).collect() == []
