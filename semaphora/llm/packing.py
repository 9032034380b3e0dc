"""Packing along a space-filling curve.

Every text is tokenised once. Its hashed token vector is projected to a few dimensions, the place there becomes a
key on a Hilbert curve, and documents are range-sorted by that key, so neighbours on the curve are neighbours in
sequences. Each range is cut into full sequences as it streams by; what is left of a range at its end is cut into
sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, written

LENGTH = 1024
DIMENSIONS, BITS = 4, 10
SEPARATOR = 0
#: Tokens of a range of the curve, which one task cuts into sequences.
RANGE_TOKENS = 4 << 20
#: Pieces that a task remembers the ids of.
CACHE = 3 << 18
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Byte-level BPE never merges across these cuts: a word with the blank before it, and white space between words.
PIECES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


# Fixed value: how byte-level BPE cuts text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _merger(path: str):
    """A fast encoder of the same byte-level BPE, or None where the file is of another kind.

    Where ids ascend with the order of merges, an id is its merge's rank."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec.get("normalizer") or model.get("unk_token") or model.get("end_of_word_suffix"):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Token ids of texts. Words repeat, so the ids of a piece are remembered; the memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer, self._known, self._fast = Tokenizer.from_file(path), {}, _merger(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self._tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def of(self, text: str) -> bytes:
        """The ids of text, one after the other, as self.kind."""
        if any(s in text for s in self._special) or not self._fast:
            return self._whole(text)
        pieces, known = PIECES.findall(text), self._known
        new = [p for p in set(pieces) if p not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(pieces)
        for p in new:
            known[p] = array("H" if self.kind is np.uint16 else "I", self._fast.encode_ordinary(p)).tobytes()
        return b"".join(map(known.__getitem__, pieces))


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One for each worker process, so that what it remembers outlives a task."""
    return Ids(path)


def hilbert(place: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys on the Hilbert curve for rows of integer places (0 to 2**bits - 1), by transposing Gray code."""
    x = place.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _signs() -> np.ndarray:
    """A row of +1 and -1 for each token id that fits 16 bits, by hash."""
    h = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (((h[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1)


def places(ids: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """The hashed token vectors, projected: coordinates of about a normal distribution, dealt evenly to the grid."""
    out = np.zeros((len(ids), DIMENSIONS))
    for k, d in enumerate(ids):
        token, c = np.unique(d.astype(np.uint16), return_counts=True)
        if len(token):
            w = np.log1p(c)
            out[k] = w @ signs[token] / np.sqrt((w * w).sum())
    even = 1 / (1 + np.exp(-1.702 * out))
    return np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def _tokenised(path: str):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, signs = ids_of(path), _signs()
        end = np.array([SEPARATOR], dtype=own.kind).tobytes()
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                blobs = [own.of(t or "") + end for t in batch.column(1).to_pylist()]
                ids = [np.frombuffer(b, dtype=own.kind) for b in blobs]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert(places([i[:-1] for i in ids], signs))), pa.array([len(i) for i in ids], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "curve_key", "doc_tokens", "ids"])

    return run


PIECE = [("doc_id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("curve_key", pa.int64())]


def _cut(length: int):
    """Cuts a sorted partition into pieces. Only the last, unfinished sequence is held back until its end is known."""

    def rows_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(PIECE)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t or id_type) for c, (_, t) in zip(cols, PIECE, strict=True)], [n for n, _ in PIECE])

    def finished(tail: list[tuple], sequence: int, power: bool) -> list[tuple]:
        """The pieces of an unfinished sequence, cut anew at power-of-two lengths."""
        total = sum(n for *_, n in tail)
        ends, out = [length] if not power else [], []
        if power:
            for bit in range(length.bit_length() - 1, -1, -1):
                if total >> bit & 1:
                    ends.append(1 << bit)
        room, offset = ends.pop(0) if ends else 0, 0
        for doc, start, key, tokens, ids, n in tail:
            at = 0
            while at < n:
                take = min(n - at, room - offset)
                out.append((doc, start + at, take, zlib.crc32(ids[at : at + take].astype("<u4").tobytes()), tokens, sequence, offset, key))
                at, offset = at + take, offset + take
                if offset == room and ends:
                    sequence, room, offset = sequence + 1, ends.pop(0), 0
        return out

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, offset, tail, id_type = TaskContext.get().partitionId() << 40, 0, [], pa.int64()
        for batch in it:
            id_type, rows = batch.schema.field("doc_id").type, []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "curve_key", "doc_tokens", "ids")]
            for doc, key, tokens, blob in zip(*cols, strict=True):
                ids, at = np.frombuffer(blob, dtype=np.uint16 if len(blob) == 2 * tokens else np.uint32), 0
                while at < tokens:
                    take = min(tokens - at, length - offset)
                    tail.append((doc, at, key, tokens, ids[at : at + take], take))
                    at, offset = at + take, offset + take
                    if offset == length:
                        rows += finished(tail, sequence, False)
                        sequence, offset, tail = sequence + 1, 0, []
            yield rows_of(rows, id_type)
        if tail:
            yield rows_of(finished(tail, sequence, True), id_type)

    return run


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, curve_key, doc_tokens, ids (binary, with the separator id 0) of every whole text; null counts as empty."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, curve_key long, doc_tokens long, ids binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_tokenised(tokenizer), schema)


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, n_ranges: int | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key) of sequences of at most
    length tokens (a power of two) that hold every token of docs once.

    tokenizer: path of a tokenizer file. Documents follow each other by curve_key, then doc_id; a null text is the
    separator alone, a null id is kept, repeated rows are packed as often as they stand there, and an empty table
    gives no piece. Other columns are ignored. n_ranges: ranges of the curve, by default one for RANGE_TOKENS tokens and
    a session's partitions at least."""
    if length & (length - 1):
        raise ValueError("length has to be a power of two")
    spark = docs.sparkSession
    rows = written(tokenised(docs, tokenizer), "tokens")
    if n_ranges is None:
        tokens = rows.agg(F.sum("doc_tokens").alias("n")).first()["n"] or 0
        n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE_TOKENS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("curve_key"), F.col("doc_id"), F.col("doc_tokens")]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long"
    return rows.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order).mapInArrow(_cut(length), schema)
