"""Language identification by language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: slot s holds a mask (of as many 64-bit words as the languages need)
with a bit for each language whose filter has bit s set. AND-ing the masks at an n-gram's slots gives all languages that contain it, in one look-up for all of
them. A text's n-grams are looked up, each language's hits are counted and corrected for its filter's
false-positive rate, and the largest corrected count decides.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, carried, kept_as, mixed, texts_of

SIZES = (2, 3, 4)
SLOTS = 1 << 19
PROBES = 3
WORD = 64


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all n-grams of all texts, the text each comes from, whether a text has a letter).

    Texts are lower-cased and each run of other characters counts as one blank; an n-gram may begin or end with a
    blank but holds none inside, and the blank around a text counts."""
    lower = [(t or "").lower() for t in texts]
    raw = np.frombuffer(("\0" + "\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lower), dtype=np.int64, count=len(lower)))
    letter = _letters()[raw]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    at = np.cumsum(keep)  # kept characters up to here
    bounds = at[ends]
    first = np.concatenate(([1], bounds[:-1]))
    has = np.add.reduceat(np.append(letter, False).astype(np.int64), np.concatenate(([1], ends[:-1] + 1))) > 0 if len(lower) else np.zeros(0, bool)
    c = np.where(letter, raw, 0)[keep].astype(np.uint64)
    owner = np.zeros(len(c), dtype=np.int32)
    np.add.at(owner, first[1:][first[1:] < len(c)], 1)
    owner = np.cumsum(owner)
    found, of = [], []
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + c[j : len(c) - n + 1 + j]
        ok = np.ones(len(h), dtype=bool)
        for j in range(1, n - 1):
            ok &= c[j : len(c) - n + 1 + j] != 0
        found.append(mixed(h[ok]))
        of.append(owner[1 : len(c) - n + 2][ok])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(of) if of else np.zeros(0, np.int32), has


@dataclass
class LanguageFilters:
    """languages, in the order of their bits; masks by word (of WORD languages) and slot; each language's
    false-positive rate; the fallback's bit."""

    languages: list[str]
    masks: np.ndarray
    false_positive: np.ndarray
    fallback: int

    def probe(self, grams: np.ndarray) -> np.ndarray:
        """The bitmask of languages for each n-gram, a row for each word of it."""
        found = self.masks[:, (grams & np.uint64(SLOTS - 1)).astype(np.int64)]
        for i in range(1, PROBES):
            found = found & self.masks[:, ((grams >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64)]
        return found

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected hits, a row for each text and a column for each language; whether a text has a letter; its n-grams."""
        grams, of, has = _grams(texts)
        total = np.bincount(of, minlength=len(texts))
        masks, hits = self.probe(grams), np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            known = (masks[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1) == 1
            hits[:, k] = np.bincount(of[known], minlength=len(texts))
        return np.maximum(0, (hits - total[:, None] * self.false_positive) / (1 - self.false_positive)), has, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The languages, their scores, and the share of a text's n-grams that its language knows."""
        counts, has, grams = self.counts(texts)
        best, total = counts.argmax(axis=1), counts.sum(axis=1)
        best = np.where(total > 0, best, self.fallback)
        top = counts[np.arange(len(texts)), best]
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has & (total > 0), top / np.maximum(total, 1e-9), 0.0), np.where(has, top / np.maximum(grams, 1), 0.0)


#: N-grams of small batches that are counted together before they are handed on.
HELD = 1 << 20


def _count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for lang, parts in sorted(held.items()):
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "c"])
        held.clear()

    for batch in batches(it, 128):
        langs = np.array(texts_of(batch, "lang"), dtype=object)
        grams, of, _ = _grams(texts_of(batch, "text"))
        for lang in sorted(set(langs)):
            held.setdefault(lang, []).append(np.unique(grams[(langs == lang)[of]], return_counts=True))
            size += len(held[lang][-1][0])
        if size > HELD:
            yield from merged()
            size = 0
    yield from merged()


def fit(train: DataFrame, max_docs: int = 20_000, share: float = 2e-5, ratio: float = 0.1) -> LanguageFilters:
    """Fits the filters on rows (doc_id, text, lang) with non-null text and lang; a null id counts like any other.

    At most about max_docs rows are used (a documented bound for a fit on labelled rows): each language has an equal
    part of them, of the least hashes of doc_id, or all its rows if they are fewer, so that no language is lost. A
    language's filter holds the n-grams that make at least share of its n-grams, so at most len(SIZES)/share of them,
    and at least ratio of the largest share that any language has, so that a few foreign passages don't fill it.
    Without rows there is no language: every text is then 'und'. There may be any number of languages."""
    train = train.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if sum(sizes.values()) > max_docs:
        part = [(lang, int(min(1.0, max_docs / len(languages) / n) * (1 << 30))) for lang, n in sizes.items()]
        upto = train.sparkSession.createDataFrame(part, "_lang string, _upto long")
        under = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_upto")
        train = train.join(F.broadcast(upto), F.col("lang") == F.col("_lang")).filter(under).select("doc_id", "text", "lang")
    counts = train.mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    p = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("c") / F.col("total")).alias("p")).filter(F.col("p") >= share)
    rows = p.toPandas()  # at most languages / share rows
    masks = np.zeros((max(1, -(-len(languages) // WORD)), SLOTS), dtype=np.uint64)
    rows = rows[rows["p"] >= ratio * rows.groupby("gram")["p"].transform("max")]
    for k, lang in enumerate(languages):
        g = rows.loc[rows["lang"] == lang, "gram"].to_numpy(dtype=np.int64).view(np.uint64)
        for i in range(PROBES):
            np.bitwise_or.at(masks[k // WORD], ((g >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64), np.uint64(1 << k % WORD))
    fill = np.array([((masks[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean() for k in range(len(languages))])
    return LanguageFilters(languages, masks, fill**PROBES, max(range(len(languages)), key=lambda k: sizes[languages[k]], default=0))


def identify(docs: DataFrame, filters: LanguageFilters, *keep: str) -> DataFrame:
    """doc_id, the columns keep, lang_pred, score and coverage for every document of docs (doc_id, text).

    lang_pred is 'und', with score 0, where the text is null or has no letter. score is the share of the decided
    language in all languages' corrected hits; if no n-gram is known, the most frequent language with score 0.
    coverage is the share of the text's n-grams that the decided language knows; it does not depend on how many
    languages there are. Whole texts count, repeated rows are predicted alike, and null ids pass through. A kept column
    that is named like an output comes out with _in after its name."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            texts = [None if t is None else t.decode("utf-8", "replace") for t in texts_of(batch, "_text")]
            lang, *figures = filters.judged(texts) if filters.languages else (["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)))
            out = [pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in figures)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "lang_pred", "score", "coverage"])

    rows, schema = carried(docs, keep, ["lang_pred", "score", "coverage"])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, coverage double")


def accepted(docs: DataFrame, filters: LanguageFilters, least: float = 0.4) -> DataFrame:
    """docs without those that have no language: no letter, no text, or less than least of the n-grams known to the best
    language. All columns stay, repeated rows and null ids as they are."""
    rest = [c for c in docs.columns if c != "doc_id"]
    names = kept_as(rest, ["doc_id", "_text", "lang_pred", "score", "coverage"])
    known = identify(docs, filters, *rest).filter((F.col("lang_pred") != "und") & (F.col("coverage") >= least))
    return known.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))
