"""Language-model scoring with an interpolated modified Kneser-Ney n-gram model.

N-grams are counted in Spark: every task counts its own texts, and counts go to shards by the n-gram's hash. A shard
of the highest order becomes a file of sorted 64-bit hashes with their counts. What it knows of shorter n-grams goes
on to shards of the next order below: as a context, how many followers an n-gram has once, twice or more often and
what their counts sum to; as an ending, how many different words stand before it. So it goes down to words. Workers
memory-map the files that they need and look sorted queries up, so a model larger than memory costs page cache, not
heap. Only a row of sums for each shard reaches the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, carried, docs_of, mapped, mixed, mounted, saved, shared_dir, texts_of

START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000002)
#: Tokens that a task counts at once before it hands their counts on.
CHUNK = 1 << 21
#: Bytes of text that a shard's n-grams come from, on the average.
SHARD_BYTES = 16 << 20
_SALT = np.uint64(0x9E3779B97F4A7C15)
#: Of an n-gram below the highest order: occurrences (words only), different words before it; as a context: the sum of
#: its followers' counts, and how many followers have a count of 1, 2, and more.
SUMS = ("count", "before", "total", "once", "twice", "often")


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * _SALT + mixed(right ^ np.uint64(0xA0761D6478BD642F)))


def gram_key(words: list[np.ndarray]) -> np.ndarray:
    """The hash of each n-gram, its words given by position; of a single word, its own."""
    key = words[0]
    for w in words[1:]:
        key = pair_key(key, w)
    return key


def _shard(key: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted keys are sorted by shard too."""
    return ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _packed(*arrays: np.ndarray) -> bytes:
    body = b"".join(a.tobytes() for a in arrays)
    return zstandard.compress(np.array([len(a) for a in arrays], dtype=np.int64).tobytes() + body, 1)


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(raw, dtype=np.int64, count=len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += out[-1].nbytes
    return out


def _summed(words: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams in the order of their keys: keys, words, and for each the sums of values."""
    key = gram_key(words)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = lambda v: np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return key[first], [w[order[first]] for w in words], [total(v) for v in values]


def token_stream(h: np.ndarray, counts: np.ndarray, order: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, first): each token, an end after each text, with the order-1 tokens before it, the token last;
    starts stand before a text. first: where a text begins."""
    sizes = counts + 1
    last = np.cumsum(sizes) - 1
    right = np.empty(len(h) + len(counts), dtype=np.uint64)
    word = np.ones(len(right), dtype=bool)
    word[last] = False
    right[word], right[last] = h, END
    first, columns = last - counts, [right]
    for _ in range(order - 1):
        left = np.empty_like(right)
        left[1:] = columns[0][:-1]
        left[first] = START
        columns.insert(0, left)
    return columns, first


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["level", "shard", "blob"])


ROWS = "level int, shard int, blob binary"


def _dealt(level: int, n_shards: int, key: np.ndarray, words: list[np.ndarray], values: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Rows (level, shard, blob) of n-grams in the order of their keys."""
    cut = np.searchsorted(_shard(key, n_shards), np.arange(n_shards + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(cut)).tolist():
        x, y = int(cut[s]), int(cut[s + 1])
        # in the order of the first word: neighbours then share their high bytes; the key follows from the words
        o = np.argsort(words[0][x:y], kind="stable") + x
        yield level, s, _packed(*(w[o] for w in words), *(v[o].astype(np.uint32) for v in values))


def _counted(n_shards: int, order: int):
    """Rows of the n-grams of a chunk of texts with their counts."""

    def flush(chunk: list[list[np.ndarray]]) -> pa.RecordBatch:
        words = [np.concatenate(c) for c in zip(*chunk, strict=True)]
        return _rows(list(_dealt(order, n_shards, *_summed(words, [np.ones(len(words[0]), np.uint8)]))))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk, n = Words(), [], 0
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                columns, _ = token_stream(*words.of(texts_of(batch.slice(at, 256), "text")), order)
                chunk.append(columns)
                n += len(columns[0])
                if n >= CHUNK:
                    yield flush(chunk)
                    chunk, n = [], 0
        if n:
            yield flush(chunk)

    return run


TOP = [np.uint64, np.uint64, np.uint32]
BELOW = [np.uint64, *[np.uint32] * len(SUMS)]
WORD = [np.uint64, np.uint64, np.uint32, np.uint64, *[np.uint32] * 3]
STATS = "level int, shard int, n1 long, n2 long, n3 long, n4 long, types long, total long"


def _times(c: np.ndarray) -> list[int]:
    """How many of c are 1, 2, 3 and 4; how many there are; their sum."""
    return [*(int((c == k).sum()) for k in (1, 2, 3, 4)), len(c), int(c.sum())]


def _by_shard(it: Iterable[pa.RecordBatch]) -> dict[tuple[int, int], list[bytes]]:
    held: dict[tuple[int, int], list[bytes]] = {}
    for batch in it:
        for level, s, blob in zip(*(texts_of(batch, c) for c in ("level", "shard", "blob")), strict=True):
            held.setdefault((level, s), []).append(blob)
    return held


def _joined(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_unpacked(b, *kinds) for b in blobs), strict=True)]


def _file(folder: str, level: int, shard: int) -> str:
    return f"{folder}/{level}-{shard:06d}"


def _files(folder: str, n_shards: int, level: int, order: int):
    """Writes each shard of one level; hands on what it knows of the levels below, and its own sums as level 0.

    Rows of other levels pass."""
    top = level == order

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at, shard), blobs in sorted(_by_shard(it).items()):
            if at != level:
                yield _rows([(at, shard, b) for b in blobs])
                continue
            got = _joined(blobs, *[np.uint64] * level, *[np.uint32] * (1 if top else len(SUMS)))
            key, words, sums = _summed(got[:level], got[level:])
            del got
            if top:
                c, once = sums[0], sums[0] == 1
                saved(_file(folder, level, shard), key[once], key[~once], np.minimum(c[~once], (1 << 32) - 1).astype(np.uint32))
            else:
                c = sums[1]
                saved(_file(folder, level, shard), *(x.astype(k) for x, k in zip((key, *sums), WORD if level == 1 else BELOW, strict=True)))
            seen = c > 0
            out = [(0, shard, np.array([level, shard, *_times(c[seen])], dtype=np.int64).tobytes())]
            if level == 1:
                out.append((0, shard, np.array([0, shard, 0, 0, 0, 0, int((sums[0] > 0).sum()), int(sums[0].sum())], dtype=np.int64).tobytes()))
            else:
                words, c = [w[seen] for w in words], c[seen]
                one, none = np.ones(len(c), np.uint8), np.zeros(len(c), np.uint8)
                # the ending without the first word has one word more before it; the context without the last one more follower
                ending, context = [none, one, none, none, none, none], [none, none, c, c == 1, c == 2, c > 2]
                below = _summed([np.concatenate(x) for x in zip(words[1:], words[:-1], strict=True)], [np.concatenate(x) for x in zip(ending, context, strict=True)])
                parts = [(level - 1, below)]
                if top:
                    counts = _summed(words[-1:], [c, none, none, none, none, none])
                    if level == 2:
                        parts = [(1, _summed([np.concatenate((below[1][0], counts[1][0]))], [np.concatenate(x) for x in zip(below[2], counts[2], strict=True)]))]
                    else:
                        parts.append((1, counts))
                for to, part in parts:
                    out += _dealt(to, n_shards, *part)
            yield _rows(out)

    return run


def _stats(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = [np.frombuffer(b, dtype=np.int64).tolist() for b in texts_of(batch, "blob")]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if k < 2 else pa.int64()) for k, c in enumerate(cols)], [x.split()[0] for x in STATS.split(", ")])


@dataclass
class KneserNey:
    """folder of the sorted hash arrays, the order, the number of shards and which of each level there are, and the few
    sums that fix the discounts: discounts[level - 1] for counts of 1, 2 and more."""

    folder: str
    order: int
    n_shards: int
    present: dict[int, frozenset[int]]
    tokens: int
    words: int
    types: int
    discounts: list[tuple[float, float, float]]
    spread: float
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _find(self, level: int, kinds: list, keys: np.ndarray, give) -> None:
        """Calls give(slice of keys, arrays of their shard) for each shard that sorted keys touch. A shard that was
        written and can't be read is an error: its n-grams are not unseen ones."""
        if not len(keys):
            return
        cut = np.searchsorted(_shard(keys, self.n_shards), np.arange(self.n_shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if s in self.present.get(level, ()):
                if (level, s) not in self._open:
                    self._open[level, s] = mapped(_file(self.folder, level, s), kinds)
                give(slice(int(cut[s]), int(cut[s + 1])), self._open[level, s])

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct n-gram keys of the highest order; 0 where unseen."""
        out = np.zeros(len(keys), dtype=np.int64)

        def give(part: slice, arrays: list[np.ndarray]) -> None:
            once, often, c = arrays
            if len(once):
                at = np.minimum(np.searchsorted(once, keys[part]), len(once) - 1)
                out[part] = once[at] == keys[part]
            if len(often):
                at = np.minimum(np.searchsorted(often, keys[part]), len(often) - 1)
                out[part] += np.where(often[at] == keys[part], c[at], 0)

        self._find(self.order, TOP, keys, give)
        return out

    def sums(self, level: int, keys: np.ndarray) -> np.ndarray:
        """A row of SUMS for each sorted distinct key of a level below the highest."""
        out = np.zeros((len(keys), len(SUMS)), dtype=np.int64)

        def give(part: slice, arrays: list[np.ndarray]) -> None:
            known = arrays[0]
            at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            hit = known[at] == keys[part]
            for k in range(len(SUMS)):
                out[part, k] = np.where(hit, arrays[k + 1][at], 0)

        self._find(level, WORD if level == 1 else BELOW, keys, give)
        return out

    def log10(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the model's probability of each token after those before it, the token's count)."""
        p = known = above = None
        for level in range(1, self.order):
            # what this level knows of the endings, and of the contexts for the level above
            ending, context = gram_key(columns[-level:]), gram_key(columns[-level - 1 : -1])
            key, at = np.unique(np.concatenate((ending, context)), return_inverse=True)
            rows = self.sums(level, key)
            e, c = rows[at[: len(ending)]], rows[at[len(ending) :]]
            if level == 1:
                known = e[:, 0]
                d = np.array([0.0, *self.discounts[0]])
                p = np.maximum(e[:, 1] - d[np.minimum(e[:, 1], 3)], 0) / max(self.types, 1) + self.spread / (self.words + 1)
            else:
                p = self._interpolated(level, e[:, 1], above, p)
            above = c
        key, at = np.unique(gram_key(columns), return_inverse=True)
        return np.log10(self._interpolated(self.order, self.counts(key)[at], above, p)), known

    def _interpolated(self, level: int, c: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[level - 1]])
        total = np.maximum(context[:, 2], 1)
        return np.where(context[:, 2] > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / total + (context[:, 3:] @ d[1:]) / total * lower, lower)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; 0.5, 1, 1.5 where a corpus is too small for them."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), found, strict=True))


def fit(docs: DataFrame, order: int = 2, n_shards: int | None = None) -> KneserNey:
    """Counts the whole texts of docs and writes the model's sorted hash arrays to the shared folder.

    Tokens are runs without ASCII white space, A-Z lower-cased, and an end after each text; null and empty texts
    are an end alone, repeated rows count as often as they stand there. An empty table gives a model that spreads
    all probability evenly. order: the length of its n-grams, 2 or more; starts are filled in before a text. A task
    holds a shard of n-grams, so the number of shards grows with the bytes of text (one for SHARD_BYTES, and a
    session's partitions at least) unless n_shards names it. The folder has to be a mounted one, since workers
    memory-map it; a shard that a worker can't read is an error."""
    if order < 2:
        raise ValueError("an interpolated model needs n-grams of two words at least")
    spark = docs.sparkSession
    if n_shards is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = mounted(f"{shared_dir(spark)}/semaphora/kneser-ney-{uuid.uuid4().hex}")
    rows = docs_of(docs).mapInArrow(_counted(n_shards, order), ROWS)
    for level in range(order, 0, -1):
        rows = rows.repartitionById(n_shards, F.col("shard")).mapInArrow(_files(folder, n_shards, level, order), ROWS)
    stats = rows.mapInArrow(_stats, STATS).groupBy("level").agg(F.collect_set("shard").alias("shards"), *(F.sum(x).alias(x) for x in ("n1", "n2", "n3", "n4", "types", "total"))).collect()
    by = {r["level"]: r for r in stats}
    times = lambda level: tuple(by[level][x] for x in ("n1", "n2", "n3", "n4")) if level in by else (0, 0, 0, 0)
    discounts, (d1, d2, d3) = [_discounts(*times(level)) for level in range(1, order + 1)], _discounts(*times(1))
    types, spread = by[1]["total"] if 1 in by else 0, 1.0
    if types:
        spread = (d1 * by[1]["n1"] + d2 * by[1]["n2"] + d3 * (by[1]["types"] - by[1]["n1"] - by[1]["n2"])) / types
    present = {level: frozenset(r["shards"]) for level, r in by.items() if level}
    return KneserNey(folder, order, n_shards, present, by[0]["total"] if 0 in by else 0, by[0]["types"] if 0 in by else 0, types, discounts, spread)


def score(docs: DataFrame, model: KneserNey, *keep: str) -> DataFrame:
    """doc_id, the columns keep, n_tokens, n_known, train_tokens, base_score, score for every document.

    score: log10 of the model's probability of the whole text with its end; base_score: the same of add-one
    unigrams; n_known: tokens seen in training. Null and empty texts are an end alone; repeated rows score alike, null
    ids pass through. A kept column that is named like an output comes out with _in after its name."""
    outputs = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, floor = Words(), np.log10(float(model.tokens + model.words + 1))
        for whole in it:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                columns, first = token_stream(*words.of(texts_of(batch, "_text")), model.order)
                p, c = model.log10(columns)
                total = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
                sizes = np.diff(np.append(first, len(columns[0])))
                found = [sizes, total((c > 0).astype(np.int64)), np.full(batch.num_rows, model.tokens), total(np.log10(c + 1.0) - floor), total(p)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], [*batch.schema.names[:-1], *outputs])

    rows, schema = carried(docs, keep, outputs)
    return rows.mapInArrow(run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
