"""MinHash near-duplicates with odd sketches.

A document's distinct word shingles are MinHashed. Bands of samples give candidates; each document also folds all
its samples into a parity bitmap (an odd sketch), and the population count of the XOR of two bitmaps estimates how
many samples differ, which is precise where similarity is high. Candidates that the estimate leaves possible are
confirmed on the full shingle sets, and confirmed links form components.

Equal shingle sets are one class from the start. In a band's bucket every class is compared with the smallest class
(a star), never all with all. Where a bucket still holds several components after that, the members of different
components are compared with each other too, so that a link that no star shows is not lost. Those few get a second
odd sketch of many more samples, so that what lies just below the threshold does not go to the exact test.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, components, docs_of, mixed, removed, shingle_sets, texts_of, written

BANDS, ROWS = 32, 5
SKETCH_BITS = 512
#: Below the threshold by this much, an estimate still goes to the exact test: over five standard deviations.
MARGIN = 0.2
#: The second sketch; one standard deviation of its estimate is 0.01 at a similarity of 0.8.
FINE_SAMPLES, FINE_BITS, FINE_MARGIN = 2048, 4096, 0.055
#: Ids that a task may hold to pick texts by; beyond that, texts and ids meet in a shuffle.
BROADCAST_IDS = 4_000_000
#: Partners that meet the text of one document in one place.
MEMBERS = 256


def _parameters(samples: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, samples + 1, dtype=np.uint64)
    return mixed(i * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1), mixed(i * np.uint64(0xD1B54A32D192ED03)).astype(np.uint32)


def minhash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sample for each (a, b): the least value of a*h+b in 32 bits. Long sets go in blocks."""
    h, best = h.astype(np.uint32), np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 1024):
        m = h[None, at : at + 1024] * a[:, None]
        m += b[:, None]
        np.minimum(best, m.min(axis=1), out=best)
    return best.astype(np.uint64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity bitmap of the samples, each taken with its position."""
    at = mixed(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


SIGNATURE = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def _sign(n: int):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = Words(), _parameters()
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches(it):
            rows = []
            for s in shingle_sets(texts_of(batch, "text"), n, words):
                if not len(s):
                    rows.append((0, b"", None, None))
                    continue
                m = minhash(s, a, b)
                acc = salt.copy()
                for r in range(ROWS):
                    acc = mixed(acc + m[r::ROWS])
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), acc.view(np.int64), np.frombuffer(odd_sketch(m), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return run


LANES = SKETCH_BITS // 64


def _lanes(df: DataFrame, to: str) -> DataFrame:
    """doc_id as to, with the set size and the bitmap's words as plain columns, which compiled code compares."""
    return df.select(F.col("doc_id").alias(to), F.col("n_shingles").alias(f"n_{to}"), *(F.col("sketch")[i].alias(f"{to}{i}") for i in range(LANES)))


def _most_odd(percent: int, samples: int, bits: int, margin: float) -> float:
    """Odd bits that two sketches' XOR is expected to have at a similarity of percent less margin."""
    return bits / 2 * (1 - math.exp(-4 * samples * (1 - (percent / 100 - margin)) / bits))


def _likely(percent: int) -> Column:
    """Whether the XOR's population count leaves a similarity of percent possible for (a, b), by sketches and sizes."""
    pop = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(LANES)), F.lit(0))
    return (pop <= _most_odd(percent, BANDS * ROWS, SKETCH_BITS, MARGIN)) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def _finely_likely(percent: int) -> Column:
    """_likely by the second sketches fine_a and fine_b; a document without one passes."""
    pop = F.aggregate(F.zip_with("fine_a", "fine_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.coalesce(pop <= _most_odd(percent, FINE_SAMPLES, FINE_BITS, FINE_MARGIN), F.lit(True))


def _fine_rows(n: int):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = Words(), _parameters(FINE_SAMPLES)
        for batch in batches(it):
            sets = shingle_sets(texts_of(batch, "text"), n, words)
            rows = [np.frombuffer(odd_sketch(minhash(s, a, b), FINE_BITS), dtype=np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(rows, pa.list_(pa.int64()))], ["a", "fine_a"])

    return run


def _fine(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(a, fine_a): the second sketch of each of ids (doc_id); none for an id whose rows differ in text."""
    rows = _picked(texts, ids).mapInArrow(_fine_rows(n), "a long, fine_a array<long>")
    return rows.groupBy("a").agg(F.min("fine_a").alias("lo"), F.max("fine_a").alias("hi")).filter("lo = hi").select("a", F.col("lo").alias("fine_a"))


def _confirm(n: int, percent: int):
    """Of rows in the order of (b, salt), the text of b itself (a null) first: the pairs whose full sets are alike enough."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, held = Words(), None, []
        for batch in batches(it):
            out = []
            columns = [texts_of(batch, c) for c in ("a", "b", "salt")]
            for a, b, salt, own in zip(*columns, shingle_sets(texts_of(batch, "text"), n, words), strict=True):
                if (b, salt) != last:
                    last, held = (b, salt), []
                if a is None:
                    held.append(own)  # several where rows of one id differ
                    continue
                for hub in held:
                    both = len(np.intersect1d(own, hub, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(hub) - both):
                        out.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["a", "b"])

    return run


def _picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id is in ids (doc_id): without moving texts, if ids are counted to be few enough."""
    ids = ids.distinct()
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _confirmed(likely: DataFrame, texts: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """Of candidate pairs (a, b): those that the full sets confirm.

    The text of b travels once for MEMBERS of its partners, which meet it in a partition of their own, in order."""
    t = _picked(texts, likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))))
    t = written(t, name + "-texts")
    salts = likely.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    dealt = likely.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    members = dealt.join(t.withColumnRenamed("doc_id", "a"), "a").select("b", "salt", "a", "text")
    hubs = dealt.select("b", "salt").distinct().join(t.withColumnRenamed("doc_id", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    rows = members.unionByName(hubs).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    links = written(rows.mapInArrow(_confirm(n, percent), "a long, b long").distinct(), name + "-links")
    removed(t)
    return links


def _shingle_rows(n: int):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches(it, 64):
            ids, sets = texts_of(batch, "doc_id"), list(shingle_sets(texts_of(batch, "text"), n, words))
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, dtype=np.int64), sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["a", "h"])

    return run


def _alone(texts: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(a, own): how many of a's shingles no other text of members has. No link of a can share them."""
    rows = _picked(texts, members.select(F.col("a").alias("doc_id"))).mapInArrow(_shingle_rows(n), "a long, h long")
    once = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("a").alias("a")).filter("c = 1").groupBy("a").agg(F.count("*").alias("own"))
    return once


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Every document of docs (doc_id, text) with n_shingles, component_id, kept, n_links.

    n_shingles: size of the set of distinct n-word shingles. Documents whose sets meet
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id that links reach
    (itself included), kept tells whether that is the document's own. n_links counts the confirmed links of the
    document's class that were needed (equal sets are one class).

    A null or empty text has an empty set and is linked with nothing. Rows of one doc_id (a number) are one document
    in links, whatever their texts, and come out as often as they went in; a null doc_id is kept and linked with
    nothing. Other columns are ignored."""
    docs = docs.select("doc_id", "text")
    sig = written(docs_of(docs).mapInArrow(_sign(n), SIGNATURE), "signatures")
    full = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes, (full.set_key == classes.set_key) & (full.doc_id == classes.rep), "left_semi")
    reps = written(reps.select("doc_id", "set_key", "n_shingles", "bands", "sketch").dropDuplicates(["doc_id", "set_key"]).drop("set_key"), "reps")
    # the sets of an id whose rows differ belong together
    several = full.groupBy("doc_id").agg((F.min("set_key") != F.max("set_key")).alias("differ")).filter("differ").select("doc_id")
    own = full.join(several, "doc_id").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    # band: its hash, in which its number is mixed; at: the number
    band = reps.select("doc_id", F.posexplode("bands").alias("at", "band"))
    bucket = band.groupBy("band").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    member = written(band.join(bucket, "band").select("band", "at", F.col("doc_id").alias("a"), "b"), "members")
    texts = docs_of(docs.filter("doc_id is not null and text is not null"))
    near = _lanes(reps, "a").join(member.filter("a <> b").select("a", "b").distinct(), "a").join(_lanes(reps, "b"), "b")
    star = written(near.filter(_likely(percent)).select("a", "b").distinct(), "star-likely")
    links = written(_confirmed(star, texts, n, percent, "star").union(own), "links")
    label = components(links, "star-components")
    # what the stars leave open: buckets that still hold more than one component
    placed = member.join(label.withColumnRenamed("v", "a"), "a", "left").select("band", "at", "a", F.coalesce("label", "a").alias("label"))
    open_ = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band")
    rest = written(placed.join(open_, "band", "left_semi"), "open")
    # a shingle that no other open text has is in no intersection: that bounds every link of a text from above
    alone = _alone(texts, rest.select("a").distinct(), n)
    sized = rest.select("a").distinct().join(reps, F.col("a") == reps.doc_id).join(alone, "a", "left")
    most = (F.col("n_shingles") - F.coalesce("own", F.lit(0))).alias("most_a")
    sized = sized.select("a", F.col("n_shingles").alias("n_a"), *(F.col("sketch")[i].alias(f"a{i}") for i in range(LANES)), F.col("bands").alias("bands_a"), most)
    few = written(sized.filter(100 * F.col("most_a") >= percent * F.col("n_a")), "open-sizes")
    sized = written(few.join(_fine(texts, few.select(F.col("a").alias("doc_id")), n), "a", "left"), "open-sketches")
    # a row for each document, with its open bands (BANDS at most); dealt to bands only after the joins
    one = rest.groupBy("a").agg(F.min("label").alias("label"), F.collect_list(F.struct("at", "band")).alias("open")).join(sized, "a")
    one = one.withColumn("o", F.explode("open")).withColumn("band", F.col("o.band")).withColumn("bands_a", F.slice("bands_a", F.lit(1), F.col("o.at"))).drop("open", "o")
    two = one.select("band", F.col("label").alias("label_b"), *(F.col(c).alias("b" + c[1:] if c[0] == "a" else c[:-1] + "b") for c in one.columns if c not in ("band", "label")))
    most = F.least("most_a", "most_b")
    # a pair counts in the first band that both share
    new = ~F.exists(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), lambda same: same)
    enough = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    cross = one.join(two, (one.band == two.band) & (F.col("label") > F.col("label_b")) & _likely(percent) & new & enough & _finely_likely(percent))
    back = star.select(F.col("a").alias("b"), F.col("b").alias("a"))
    cross = written(cross.select("a", "b").distinct().join(star, ["a", "b"], "left_anti").join(back, ["a", "b"], "left_anti"), "cross-likely")
    more = _confirmed(cross, texts, n, percent, "cross")
    removed(member, reps, star, rest, few, sized, cross)
    if more.limit(1).count():
        links = written(links.union(more), "all-links")
        label = components(links, "all-components")
    ends = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    named = classes.join(label.withColumnRenamed("v", "rep"), "rep", "left").join(degree, "rep", "left")
    named = named.select("set_key", F.coalesce("label", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sig.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one of the smallest doc_id; all columns stay.

    Rows of one doc_id are one document: all of them stay, or none. Null and empty texts and null ids stay."""
    gone = near_duplicates(docs, n, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
