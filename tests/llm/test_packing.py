import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from semaphora.llm import packing
from semaphora.llm.queries import packing_query, tokenizer_path

from .helpers import empty, hard, hard_rows


def check(rows, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for k, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[k][r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids[k])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids[k])
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0, "full, or a power of two"


def test_every_id_once_and_no_padding(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(packing_query(spark, sf).collect(), texts)


def test_odd_texts(spark):
    texts = dict(enumerate(["a  b", " lead", "trail ", "x\n\ny", "tab\t\tz \n q", "don't  stop's", "<|endoftext|> and  <|endoftext|>x", "é  ß", "\x1c\x1d a\x85b", "\r\n\r\n", "漢字かな交じり文 ", "🙂🙂 ok", "a" * 5000]))
    check(packing.packed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer_path()).collect(), texts)


def test_random_unicode(spark):
    draw = random.Random(8)
    some = [*"aeT 0.,'\n\t", "'s", "'ll", "  ", "é", "ß", "ł", "Ω", "Ж", "א", "ع", "漢", "か", "한", "\u0301", "\u200b", "\u2009", "\xa0", "\x85", "\u3000", "²", "½", "Ⅷ", "🙂", "👩‍🚀", "\x00", "\x1f", "\ufffd", "\U000e0041", "_", "-"]
    anywhere = lambda: chr(draw.choice([draw.randrange(1, 0x300), draw.randrange(0x300, 0xD800), draw.randrange(0xE000, 0x11000)]))
    texts = {k: "".join(draw.choice(some) if draw.random() < 0.6 else anywhere() for _ in range(draw.randrange(1, 120))) for k in range(400)}
    check(packing.packed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer_path()).collect(), texts)


def test_hard_rows(spark):
    rows = packing.packed(hard(spark), tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in hard_rows()}
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 3 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 5)
    assert packing.packed(empty(spark), tokenizer_path()).count() == 0


def test_hilbert_keys_are_a_path():
    n = 16
    grid = np.array([(x, y) for x in range(n) for y in range(n)])
    keys = packing.hilbert(grid, 4)
    assert sorted(keys) == list(range(n * n))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_share_a_language(spark, sf):
    rows = packing_query(spark, sf).select("doc_id", "sequence_id", "offset").orderBy("sequence_id", "offset").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = list(dict.fromkeys(r["doc_id"] for r in rows))
    alike = lambda ids: np.mean([lang[a] == lang[b] for a, b in zip(ids, ids[1:], strict=False)])
    assert alike(order) > alike(sorted(order)) + 0.1
