"""Merkle manifest of a dataset: a hash tree over its rows by group, with an authentication path for every row.

Rows are hashed on the JVM, and only ids and digests go on. They are dealt to ranges by group and order, numbered (a
count for each range is all that the driver sees) and cut into aligned blocks of ARITY ** BLOCK_LEVELS rows. A task
folds a block to its root; the roots of a round are the nodes of the next, until each group has one. On the way back
each block is traversed once, fractally: of every level of subtrees a task keeps the one that the present row lies in
(existing) and the one after it (desired), which grows by a node at a time while the present one is used up. So
successive paths come out of bounded memory, and the path above the block, found a round earlier, is put behind them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, written

ARITY = 8
#: Levels of a subtree, and subtrees stacked in a block.
SUBTREE_LEVELS, STACKED = 1, 3
BLOCK_LEVELS = SUBTREE_LEVELS * STACKED
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The siblings left and right of a node at each level, as hex text.
Path = list[tuple[str, str]]


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(columns: list[Column]) -> Column:
    """H of values: each '-' if null, else its bytes' number, ':', and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_of(n: int, whole: bool, arity: int = ARITY, block_levels: int = BLOCK_LEVELS) -> int:
    """Levels above n nodes: whole if they are all that their group has, else those of a block."""
    if not whole:
        return block_levels
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


class Traversal:
    """The paths of successive leaves of a block, from a stack of existing and desired subtrees.

    Subtree j holds its lowest nodes (tree level j * h) and those between them and its root; its root is a lowest node
    of subtree j + 1. The desired subtree of level j reads its lowest nodes one after the other from a fold of the
    leaves that lie ahead, ARITY nodes of a level at most held in between."""

    def __init__(self, leaves: list[str], levels: int, arity: int = ARITY, h: int = SUBTREE_LEVELS):
        self.leaves, self.levels, self.arity, self.h = leaves, levels, arity, h
        self.tops = -(-levels // h)  # subtrees stacked
        self.ahead = [self._nodes(j * h) for j in range(self.tops)]
        self.existing = [self._grown(j, None) for j in range(self.tops)]
        self.desired: list[list[str]] = [[] for _ in range(self.tops)]
        self.held = 0

    def _nodes(self, level: int) -> Iterator[str]:
        """The nodes of a level from left to right, folded from leaves as they are asked for."""
        if level == 0:
            yield from self.leaves
            return
        run: list[str] = []
        for node in self._nodes(level - 1):
            run.append(node)
            if len(run) == self.arity:
                yield H(*run)
                run = []
        if run:
            yield H(*run)

    def _height(self, j: int) -> int:
        return min(self.h, self.levels - j * self.h)

    def _grown(self, j: int, lowest: list[str] | None) -> list[list[str]]:
        """The levels of a subtree from its lowest nodes; of the first subtree if there are none yet."""
        width = self.arity ** self._height(j)
        rows = [lowest if lowest is not None else list(islice(self.ahead[j], width))]
        for _ in range(self._height(j) - 1):
            below = rows[-1]
            rows.append([H(*below[k : k + self.arity]) for k in range(0, len(below), self.arity)])
        return rows

    def paths(self) -> Iterator[Path]:
        """A path for each leaf in order."""
        for i in range(len(self.leaves)):
            for j in range(self.tops):
                width = self.arity ** self._height(j)
                unit = self.arity ** (j * self.h)  # leaves below a lowest node
                if i and i % (unit * width) == 0:  # the present subtree is used up
                    self.existing[j], self.desired[j] = self._grown(j, self.desired[j]), []
                if i % unit == 0 and len(self.desired[j]) < width and (node := next(self.ahead[j], None)):
                    self.desired[j].append(node)
            self.held = max(self.held, sum(len(r) for t in self.existing for r in t) + sum(map(len, self.desired)))
            path: Path = []
            for level in range(self.levels):
                j, row = divmod(level, self.h)
                nodes = self.existing[j][row]
                at = i // self.arity**level % self.arity ** (self._height(j) - row)
                first = at - at % self.arity
                path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + self.arity])))
            yield path


def block_root(leaves: list[str], levels: int, arity: int = ARITY) -> str:
    nodes = leaves
    for _ in range(levels):
        nodes = [H(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0]


def folded(leaf: str, path: Path) -> str:
    """The root that a leaf and its path give."""
    for left, right in path:
        leaf = H(left, leaf, right)
    return leaf


def _text(path: Path) -> str:
    """A path as text: levels apart by ';', left and right by ','."""
    return "".join(f"{left},{right};" for left, right in path)


def _path(text: str) -> Path:
    return [tuple(level.split(",")) for level in text.split(";")[:-1]]


@dataclass
class _Numbered:
    """Adds a row's place in its partition's run of one group: parts sorted by group, read from the left."""

    schema: pa.Schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = []
            for g in batch.column(0).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], schema=self.schema)


def _arrow(ddl_of: DataFrame, more: list[pa.Field]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*to_arrow_schema(ddl_of.schema), *more])


def numbered(rows: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """rows with n: the place (from 0) of each in its group by order.

    Rows are dealt to sorted ranges; a group that spans ranges is numbered on by what the ranges before hold of it.
    The driver sees one row for each range: its first group and how many rows of its last group end there."""
    spark = rows.sparkSession
    keys = [group, *order]
    rows = rows.select(group, *(c for c in rows.columns if c != group))
    spread = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    schema = _arrow(rows, [pa.field("_part", pa.int32()), pa.field("_nth", pa.int64())])
    ddl = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _part int, _nth long"
    placed = written(spread.sortWithinPartitions(*keys).mapInArrow(_Numbered(schema), ddl), "numbered")
    at = F.struct("_run", "_nth")
    ranges = placed.withColumn("_run", F.col(group)).groupBy("_part").agg(F.min(at).alias("a"), F.max(at).alias("z")).orderBy("_part").collect()
    before, open_, n = [], None, 0
    for r in ranges:
        first = n if r["a"]["_run"] == open_ else 0  # rows of this range's first group in ranges before
        before.append((r["_part"], r["a"]["_run"], first))
        n = r["z"]["_nth"] + 1 + (first if r["z"]["_run"] == r["a"]["_run"] else 0)
        open_ = r["z"]["_run"]
    runs = spark.createDataFrame([b for b in before if b[2]], "_part int, _run string, _before long")
    shifted = placed.join(F.broadcast(runs), (placed["_part"] == runs["_part"]) & (placed[group] == runs["_run"]), "left")
    out = shifted.select(*(placed[c] for c in rows.columns), (placed["_nth"] + F.coalesce(runs["_before"], F.lit(0))).alias("n"))
    out._written_to = placed._written_to
    return out


_ROOTS = "g string, n long, node string"


@dataclass
class _Root:
    arity: int
    block_levels: int

    def __call__(self, key: tuple, block: pa.Table) -> pa.Table:
        g, b = (k.as_py() for k in key)
        nodes = block.sort_by("n").column("node").to_pylist()
        whole = b == 0 and len(nodes) < self.arity**self.block_levels
        return pa.table({"g": [g], "n": pa.array([b], pa.int64()), "node": [block_root(nodes, levels_of(len(nodes), whole, self.arity, self.block_levels), self.arity)]})


@dataclass
class _Paths:
    """Paths of a block's nodes, with the path above the block behind them: as text for upper rounds, or judged."""

    arity: int
    h: int
    block_levels: int
    out: Callable[[pa.Table, Iterator[Path]], pa.Table]

    def __call__(self, key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        b = key[1].as_py()
        block = block.sort_by("n")
        nodes = block.column("node").to_pylist()
        whole = b == 0 and len(nodes) < self.arity**self.block_levels
        up = _path(above.column("above")[0].as_py()) if above.num_rows else []
        within = Traversal(nodes, levels_of(len(nodes), whole, self.arity, self.block_levels), self.arity, self.h)
        return self.out(block, (p + up for p in within.paths()))


def _as_text(block: pa.Table, paths: Iterator[Path]) -> pa.Table:
    return pa.table({"g": block.column("g").combine_chunks(), "n": block.column("n").combine_chunks(), "above": [_text(p) for p in paths]}, schema=pa.schema([("g", pa.string()), ("n", pa.int64()), ("above", pa.string())]))


@dataclass
class _Judged:
    """The rows of a block: subroots are what leaves give below the levels of the tree over subroots."""

    root: str
    levels_above: int

    def __call__(self, block: pa.Table, paths: Iterator[Path]) -> pa.Table:
        leaves, subroot, proofs, roots = block.column("node").to_pylist(), None, [], []
        for leaf, now, path in zip(leaves, block.column("now").to_pylist(), paths, strict=True):
            subroot = subroot or folded(leaf, path[: len(path) - self.levels_above])
            proofs.append(H(*(x for level in path for x in level)))
            roots.append(folded(now or leaf, path))
        found = {"leaf": leaves, "subroot": [subroot] * len(leaves), "proof_sha256": proofs, "folded_root": roots, "verified": [r == self.root for r in roots]}
        return pa.table({"id": block.column("id"), **found})


@dataclass
class Shape:
    """How a tree is cut: ARITY nodes a run, subtrees of h levels, stacked in a block."""

    arity: int = ARITY
    h: int = SUBTREE_LEVELS
    stacked: int = STACKED
    parts: int | None = None
    block_levels: int = field(init=False)

    def __post_init__(self):
        self.block_levels = self.h * self.stacked


def _block(shape: Shape) -> Column:
    return F.floor(F.col("n") / shape.arity**shape.block_levels).cast("long")


def _rounds(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """nodes (g, n, node), then the block roots over them, and so on, until every group has one node."""
    rounds, root = [nodes], _Root(shape.arity, shape.block_levels)
    while True:
        blocks = rounds[-1].select("g", "n", "node").groupBy("g", _block(shape).alias("b"))
        blocks = blocks.applyInArrow(lambda key, block: root(key, block), _ROOTS)
        rounds.append(written(blocks, "block-roots"))
        if not rounds[-1].filter("n > 0").limit(1).count():
            return rounds


_ABOVE = "g string, n long, above string"


def _beside(nodes: DataFrame, above: DataFrame, paths: _Paths, ddl: str, shape: Shape) -> DataFrame:
    """What paths gives of each block of nodes with the path above it."""
    blocks = nodes.withColumn("b", _block(shape)).groupBy("g", "b")
    return blocks.cogroup(above.withColumnRenamed("n", "b").groupBy("g", "b")).applyInArrow(lambda key, block, up: paths(key, block, up), ddl)


def _upper(rounds: list[DataFrame], above: DataFrame, shape: Shape) -> DataFrame:
    """(g, n, above) of the blocks over the lowest nodes: from the one node of each group down to them."""
    paths = _Paths(shape.arity, shape.h, shape.block_levels, _as_text)
    for nodes in reversed(rounds[1:-1]):
        above = _beside(nodes, above, paths, _ABOVE, shape)
    return above


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", now: Column | None = None, shape: Shape | None = None) -> DataFrame:
    """An authentication path for every row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row's leaf is H of its columns. In each group leaves ascend by key; runs of ARITY successive nodes become their H
    until one node remains, the group's subroot; subroots by group likewise give the root. now: the digest of the row
    as it is found (null: as it was); it's folded with the untampered siblings, and is verified if that gives the root.

    Nulls of key and group come first; equal keys stand in order of their leaves, so repeated rows are leaves of their
    own and have a proof each. An empty table has no rows and no root. Columns that aren't named are not looked at."""
    shape = shape or Shape()
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first, then by bytes
    tampered = now if now is not None else F.lit(None).cast("string")
    leaves = written(docs.select(g.alias("g"), F.col(key).alias("id"), row_digest([F.col(c) for c in columns]).alias("node"), tampered.alias("now")), "leaves")
    rows = numbered(leaves, "g", ["id", "node"], shape.parts)
    rounds = _rounds(rows, shape)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "node")
    tops = numbered(subroots, "g", ["of"], shape.parts)
    over = _rounds(tops, shape)
    top = over[-1].select("node").first()
    root = top["node"] if top else ""
    first = over[-1].select("g", "n", F.lit("").alias("above"))
    paths = _Paths(shape.arity, shape.h, shape.block_levels, _as_text)
    upper = _upper(over, first, shape)
    of_tops = _beside(tops, upper, paths, _ABOVE, shape)
    named = of_tops.join(tops.select(F.col("n").alias("_n"), "of"), F.col("n") == F.col("_n"))
    named = written(named.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("n"), "above"), "subroots")
    above = written(_upper(rounds, named, shape), "paths-above")
    one = named.select("above").first()
    judged = _Paths(shape.arity, shape.h, shape.block_levels, _Judged(root, len(_path(one["above"])) if one else 0))
    ddl = f"id {docs.schema[key].dataType.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string, verified boolean"
    out = _beside(rows, above, judged, ddl, shape)
    removed(leaves, *rounds[1:], tops, *over[1:])
    return out.select(F.col("id").alias(key), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified")
