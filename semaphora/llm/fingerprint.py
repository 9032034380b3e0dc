"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each word shingle is hashed once; the hash's top bits name a bin and each bin keeps its least hash. An empty bin
takes the value of a bin that its own probe sequence meets first (optimal densification). Only the low-order bits
of the values are kept, packed; likeness is the share of agreeing bins, corrected for agreement by chance.
All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import let

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
PROBES = 4
#: Text in a range of ids, and the most ranges whose bounds a plan names.
RANGE_BYTES, MOST_RANGES = 8 << 20, 20_000


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """Hashes of all runs of n words (lower-cased, split at ASCII white space); the whole sequence if it is shorter."""

    def of(words: Column) -> Column:
        size = F.size(words)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
        return F.when(size >= n, runs).when(size > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), ""), of)


def _bin(h: Column) -> Column:
    """0 to BINS-1, in the order of signed hashes."""
    return (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("smallint")


def bins(text: Column, n: int = 5) -> Column:
    """The low-order bits of each bin's value, as array<smallint> of BINS; empty for a text without words."""

    def dense(least: Column) -> Column:
        filled = F.transform(least, _bin)

        def densified(filled: Column) -> Column:
            def value(b: Column) -> Column:
                at = lambda x: F.get(least, F.nullif(F.array_position(filled, x), F.lit(0)).cast("int") - 1)
                probe = [at(F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
                # the rest of the probe sequence: filled bins in an order of the empty bin's own
                donor = F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(b, _bin(h), F.lit(-1)).alias("order"), h.alias("h"))))["h"]
                return _low(F.coalesce(at(b), *probe, donor))

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)

        return F.when(F.size(least) == BINS, F.transform(least, _low)).when(F.size(least) > 0, let(filled, densified)).otherwise(F.array().cast("array<smallint>"))

    first = lambda h: F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(h, i - 1), 64 - BIN_BITS)))
    return let(let(F.sort_array(shingle_hashes(text, n)), first), dense)


def packed(values: Column) -> Column:
    """The fingerprint: LOW_BITS of each bin as hex digits; an empty string for a text without words."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), LOW_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two bin arrays, 0 to 1: agreement by chance is subtracted. Two texts without
    words are alike (1), one with and one without are not (0)."""
    chance = 2.0**-LOW_BITS
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.lit(float(BINS))
    both = F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def fingerprints(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_chars, fingerprint for every whole text (null counts as empty). Equal texts have equal fingerprints."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), packed(bins(text, n)).alias("fingerprint"))


def with_next(rows: DataFrame, key: str, carried: list[str], n_buckets: int) -> DataFrame:
    """rows with next_<c> for each c of carried: the values of the next row by descending key (a number); after the last,
    the first.

    Keys are dealt to ranges of about equal counts (percentiles of the key, measured first); in each range a window
    looks one row ahead, and a range's first row also goes to the range before it, where it closes the gap. So no
    task orders all rows. Null keys come last; rows of one key follow each other by a hash of what they carry, and a
    key that fills whole ranges is split by that hash."""
    rows = rows.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))).withColumn("_h", F.xxhash64(*carried))
    accuracy = 10 * n_buckets
    percentiles = [i / n_buckets for i in range(1, n_buckets)] or [0.5]
    found = rows.select("_k").agg(F.percentile_approx("_k", percentiles, accuracy).alias("q")).first()["q"] or []
    bounds, often = sorted(set(found)), {k: n for k, n in Counter(found).items() if n > 1}
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = F.lit(bounds[::step]).cast("array<bigint>"), F.lit(bounds).cast("array<bigint>")
    upto = lambda among, k: F.size(F.filter(among, lambda x: x <= k))
    block = upto(coarse, F.col("_k"))
    bucket = F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + upto(F.slice(fine, (block - 1) * step + 1, F.lit(step)), F.col("_k"))) if bounds else F.lit(0)
    # of a key that several percentiles name, the rows are dealt by their hash, behind the greater keys of the range
    parts = F.element_at(F.create_map(*(F.lit(x) for kn in often.items() for x in kn)), F.col("_k")) if often else F.lit(None)
    part = F.coalesce(1 + F.floor((F.shiftright("_h", 48) + (1 << 15)) * parts / (1 << 16)), F.lit(0))
    place = (part - bucket.cast("long") * (1 << 24)).alias("b")  # ascending as keys descend
    firsts = rows.select(place, "_k", F.bitwise_not("_h").alias("n")).groupBy("b").agg(F.max(F.struct("_k", "n")).alias("x")).orderBy("b").collect()  # a row for each range
    if not firsts:
        return rows.drop("_k", "_h").select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    heads = [(r["x"]["_k"], ~r["x"]["n"], firsts[i - 1]["b"]) for i, r in enumerate(firsts)]
    heads = rows.sparkSession.createDataFrame(heads, "_head long, _head_h long, _to long")
    dealt = rows.withColumn("_b", place).join(F.broadcast(heads), (F.col("_k") == F.col("_head")) & (F.col("_h") == F.col("_head_h")), "left")
    own, copy = (F.struct(F.col(b).alias("b"), F.lit(c).alias("copy")) for b, c in (("_b", False), ("_to", True)))
    dealt = dealt.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    w = Window.partitionBy("_at.b").orderBy("_at.copy", F.desc("_k"), "_h")
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).filter(~F.col("_at.copy"))
    return out.drop("_k", "_h", "_b", "_to", "_at", "_head", "_head_h")


def edited_fingerprints(docs: DataFrame, n: int = 5, n_buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has the text's last floor(n_chars/2) code points replaced by the first as many (or all) of the
    next document's by descending doc_id (a number; after the last: the first). Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty; null ids come last, repeated ids
    follow each other by a hash of their texts; other columns are ignored. n_buckets: ranges of ids, by default as many
    as the bytes of text ask for (RANGE_BYTES each)."""
    spark = docs.sparkSession
    if n_buckets is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, MOST_RANGES))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("bins", bins(F.col("text"), n)), "doc_id", ["text", "bins"], n_buckets)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), size - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "bins", "next_bins")
    rows = rows.withColumn("edited_bins", bins(F.col("edited"), n))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
