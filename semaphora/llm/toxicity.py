"""Toxicity by weak supervision.

Many voters each look at one kind of evidence and vote toxic, clean or not at all: lexica of words, of beginnings of
words and of word pairs (mined from labelled rows), fixed lists of insults in four languages, how many such terms
stand close together, shouting, and the absence of any of them. A generative label model explains the votes of all
training texts: the label, each voter's rates given the label, and, along a tree, how each voter's vote depends on
another's given the label. Its posterior labels train a linear classifier on hashed words and beginnings of words,
which scores texts that no voter covers, too.

Votes are counted and terms are mined in Spark; tasks hash texts in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, SPACE, Words, batches, carried, docs_of, mixed, texts_of, windows, written

#: Bounds of the fit: labelled rows that lexica are mined from, rows that the classifier sees. The label model sees all.
MAX_LABELLED, MAX_ROWS = 20_000, 20_000
FEATURES = 1 << 17
STEMS = (5, 7)
#: A mined term: its log-likelihood ratio is at least EVIDENCE times the log of the number of rows (as an information
#: criterion asks of a parameter), its rate in toxic rows RATIO times that in clean ones. Most of them for a lexicon.
EVIDENCE, RATIO, MOST_TERMS = 2.0, 8.0, 4_000
#: Terms that are close together: at most so many words apart.
CLOSE = 10

# Insults by language, each list a voter of its own, in words of lower case.
INSULTS = {
    "en": "asshole bastard bitch clown crap cretin damn disgusting dumb dumbass fool freak garbage idiot idiotic imbecile jerk loser moron pathetic pig retard scum shit stupid sucker trash ugly vermin worthless",
    "de": "abschaum arschloch bastard depp drecksau dummkopf hurensohn idiot loser mistkerl penner schlampe schwachkopf schwein trottel versager vollidiot widerlich wichser",
    "fr": "abruti batard bâtard bouffon connard connasse crétin débile enculé imbécile idiot merde minable ordure pourriture salaud salope",
    "es": "basura bastardo cabrón cretino estúpido gilipollas idiota imbécil inútil malparido mierda pendejo puta puto tonto",
}
#: The lexica, by the number that their terms' hashes are salted with.
KINDS = ("words", "stems", "pairs", *(f"insults_{x}" for x in INSULTS))
VOTERS = (*KINDS, "close", "shouting", "no_word", "no_stem", "no_pair")


def _salted(h: np.ndarray, kind: int) -> np.ndarray:
    return mixed(h + np.uint64((kind + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class Terms:
    """The hashed terms of texts, a batch at a time. Words are runs without ASCII white space and punctuation, A-Z
    lower-cased; stems are the first STEMS bytes of longer words; pairs are two successive words."""

    def __init__(self):
        self._words = Words(SPACE + PUNCTUATION)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, kind, text, position in words over all texts) of every term."""
        h, counts, start, end, _ = self._words.spans(texts)
        owner, place = np.repeat(np.arange(len(counts)), counts), np.arange(len(h))
        found = [(_salted(h, 0), 0, owner, place)]
        for n in STEMS:
            longer = np.flatnonzero(end - start > n)
            found.append((_salted(self._words.parts(start[longer], start[longer] + n), 1), 1, owner[longer], place[longer]))
        if len(h) > 1:
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            found.append((_salted(windows(h, 2)[inside], 2), 2, owner[inside], place[inside]))
        kind = np.concatenate([np.full(len(f[0]), f[1], dtype=np.int8) for f in found])
        return np.concatenate([f[0] for f in found]), kind, np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])


def sampled(df: DataFrame, most: int) -> DataFrame:
    """About most rows of df, those of the least hash of doc_id; all if they are fewer."""
    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def _term_rows(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each text with its label; they are counted before they are handed on."""
    terms = Terms()
    for batch in batches(it, 2048):
        toxic = np.array(texts_of(batch, "label"), dtype=np.int64)
        h, kind, owner, _ = terms.of(texts_of(batch, "text"))
        order = np.lexsort((owner, h))
        h, kind, owner = h[order], kind[order], owner[order]
        once = np.ones(len(h), dtype=bool)
        once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, kind, owner = h[once], kind[once], owner[once]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        t, n = (np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for x in (toxic[owner], np.ones(len(h), np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(kind[first]), pa.array(h[first].view(np.int64)), pa.array(t), pa.array(n - t)], ["kind", "term", "t", "c"])


def mined(labelled: DataFrame, toxic: int, clean: int) -> dict[int, np.ndarray]:
    """By kind, the hashes of the terms that toxic rows (text, label) have far more often than clean ones."""
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    share, odds = toxic / (toxic + clean), RATIO * toxic / max(clean, 1)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (part(t, (t + c) * share) + part(c, (t + c) * (1 - share)))
    counts = labelled.mapInArrow(_term_rows, "kind byte, term long, t long, c long").groupBy("kind", "term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = counts.filter((t >= odds * (c + 0.5)) & (g2 >= EVIDENCE * math.log(toxic + clean)))
    best = counts.groupBy("kind").agg(F.slice(F.sort_array(F.collect_list(F.struct(g2.alias("g2"), "term")), False), 1, MOST_TERMS).alias("best"))
    rows = best.select("kind", F.col("best.term").alias("terms")).collect()  # at most MOST_TERMS a kind
    return {r["kind"]: np.array(r["terms"], dtype=np.int64).view(np.uint64) for r in rows}


@dataclass
class Voters:
    """The sorted hashes of all listed terms, and for each a bit for every lexicon of KINDS that holds it."""

    terms: np.ndarray
    lexica: np.ndarray

    @staticmethod
    def of(lexica: dict[int, np.ndarray]) -> Voters:
        """lexica: the mined terms by kind 0 to 2; the fixed lists are added."""
        words, rows = Words(SPACE + PUNCTUATION), []
        for bit, name in enumerate(KINDS):
            if name.startswith("insults_"):
                rows.append((_salted(words.of([INSULTS[name[8:]].encode()])[0], 0), bit))
            else:
                rows.append((lexica.get(bit, np.zeros(0, np.uint64)), bit))
        every = np.unique(np.concatenate([r[0] for r in rows]))
        masks = np.zeros(len(every), dtype=np.int64)
        for h, bit in rows:
            masks[np.searchsorted(every, np.unique(h))] |= 1 << bit
        return Voters(every, masks)

    def votes(self, texts: list[bytes | None], terms: Terms) -> np.ndarray:
        """A row for each text, a column for each of VOTERS: 2 toxic, 1 clean, 0 no vote."""
        h, _, owner, place = terms.of(texts)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == h)
        mask, owner, place = self.lexica[at[hit]], owner[hit], place[hit]
        out = np.zeros((len(texts), len(VOTERS)), dtype=np.int8)
        for bit in range(len(KINDS)):
            out[owner[mask >> bit & 1 == 1], bit] = 2
        column = VOTERS.index
        spots = np.unique(place)  # words at which any listed term begins
        whose = _first_owner(place, owner, spots)
        close = np.flatnonzero((np.diff(spots) <= CLOSE) & (whose[1:] == whose[:-1]))
        out[whose[close], column("close")] = 2
        out[[_shouting(t or b"") for t in texts], column("shouting")] = 2
        for name, kind in (("no_word", "words"), ("no_stem", "stems"), ("no_pair", "pairs")):
            out[out[:, column(kind)] == 0, column(name)] = 1
        return out


def _first_owner(place: np.ndarray, owner: np.ndarray, spots: np.ndarray) -> np.ndarray:
    order = np.argsort(place, kind="stable")
    return owner[order][np.searchsorted(place[order], spots)]


_UPPER, _LOWER = (np.isin(np.arange(256), list(range(a, a + 26))) for a in (65, 97))


def _shouting(text: bytes) -> bool:
    """At least 30 letters A-Z and a-z, most of them capitals."""
    n = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower = int(n[_UPPER].sum()), int(n[_LOWER].sum())
    return upper + lower >= 30 and upper > lower


def _vote_rows(voters: Voters):
    """Rows (votes, n): the patterns of a batch as strings of '-', '0', '1', counted."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches(it):
            found, n = np.unique(voters.votes(texts_of(batch, "text"), terms), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(["".join("-01"[v] for v in row) for row in found], pa.string()), pa.array(n)], ["votes", "n"])

    return run


@dataclass
class LabelModel:
    """P(toxic), the tree (each voter's parent, -1 for the root), and P(vote | parent's vote, label) as
    rates[label, voter, parent's vote, vote]; the root's rows are alike. marginal[label, voter, vote]: P(vote | label)."""

    prior: float
    parent: np.ndarray
    rates: np.ndarray
    marginal: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) for rows of votes (0, 1, 2)."""
        at = np.arange(votes.shape[1])
        above = votes[:, np.maximum(self.parent, 0)]
        ratio = np.log(self.rates[1][at, above, votes]) - np.log(self.rates[0][at, above, votes])
        return 1 / (1 + np.exp(-np.clip(math.log(self.prior / (1 - self.prior)) + ratio.sum(axis=1), -30, 30)))


def _coded(patterns: list[str]) -> np.ndarray:
    return np.array([["-01".index(v) for v in p] for p in patterns], dtype=np.int64)


def _tree(weight: np.ndarray) -> np.ndarray:
    """Parents of a spanning tree of greatest weight, from voter 0."""
    k = len(weight)
    parent, best, inside = np.full(k, -1), weight[0].copy(), np.zeros(k, dtype=bool)
    inside[0], source = True, np.zeros(k, dtype=np.int64)
    for _ in range(k - 1):
        new = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[new], inside[new] = source[new], True
        closer = weight[new] > best
        best[closer], source[closer] = weight[new][closer], new
    return parent


def label_model(patterns: list[str], counts: list[int], rounds: int = 60) -> LabelModel:
    """Expectation maximisation over counts of vote patterns.

    The first round takes votes for independent given the label; each one after it measures how much every two voters'
    votes, as values, tell about each other given the label, and keeps the dependences of the tree that holds most of
    it. A voter that repeats another adds nothing to the posterior, and voters that merely speak together but
    disagree are not taken for repeats."""
    votes, n = _coded(patterns), np.array(counts, dtype=float)
    k = votes.shape[1]
    one = (votes[:, :, None] == np.arange(3)).astype(float)  # pattern, voter, vote
    flat = one.reshape(len(votes), 3 * k)
    # where to start: a vote is right far more often than wrong
    marginal = np.zeros((2, k, 3))
    marginal[1], marginal[0] = np.array([0.55, 0.05, 0.40]), np.array([0.50, 0.48, 0.02])
    model = LabelModel(0.1, np.full(k, -1), np.repeat(marginal[:, :, None, :], 3, axis=2), marginal)
    for i in range(rounds):
        p = model.posterior(votes)
        prior = float(np.clip((p * n).sum() / n.sum(), 0.001, 0.999))
        marginal, pair, told = np.zeros((2, k, 3)), np.zeros((2, k, 3, k, 3)), np.zeros((k, k))
        for label, w in ((1, p * n), (0, (1 - p) * n)):
            joint = (flat.T @ (flat * w[:, None])).reshape(k, 3, k, 3)
            marginal[label] = (w @ flat).reshape(k, 3) + 0.5
            marginal[label] /= marginal[label].sum(axis=1, keepdims=True)
            # a few imagined votes, spread as if voters were independent
            alone = marginal[label][:, :, None, None] * marginal[label][None, None]
            pair[label] = (joint + alone) / (w.sum() + 1)
            told += (pair[label] * np.log(pair[label] / alone)).sum(axis=(1, 3)) * (w.sum() / n.sum())
        parent = _tree(told) if i else np.full(k, -1)
        rates = np.repeat(marginal[:, :, None, :], 3, axis=2)
        for v in np.flatnonzero(parent >= 0):
            both = pair[:, parent[v], :, v, :]  # label, parent's vote, vote
            rates[:, v] = both / both.sum(axis=2, keepdims=True)
        model = LabelModel(prior, parent, rates, marginal)
    return model


def slots(texts: list[bytes | None], terms: Terms) -> Iterator[np.ndarray]:
    """For each text the sorted distinct slots of its hashed words and stems."""
    h, kind, owner, _ = terms.of(texts)
    use = kind < 2
    key = np.unique(owner[use] * FEATURES + (h[use] % np.uint64(FEATURES)).astype(np.int64))
    cut = np.searchsorted(key, np.arange(len(texts) + 1) * FEATURES)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield key[a:b] % FEATURES


@dataclass
class Toxicity:
    """The voters, the label model and the classifier's weights; none if there was nothing to learn from."""

    voters: Voters
    labels: LabelModel | None
    weights: np.ndarray | None
    bias: float = 0.0


def _example_rows(voters: Voters, model: LabelModel):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches(it):
            texts = texts_of(batch, "text")
            p = model.posterior(voters.votes(texts, terms).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(list(slots(texts, terms)), pa.list_(pa.int32()))], ["posterior", "slots"])

    return run


@F.udf(VectorUDT())
def _vector(at: list[int]) -> SparseVector:
    return SparseVector(FEATURES, at, [1.0] * len(at))


def fit(labelled: DataFrame, unlabelled: DataFrame, max_labelled: int = MAX_LABELLED, max_rows: int = MAX_ROWS) -> Toxicity:
    """labelled: rows (doc_id, text, label 0/1) that lexica are mined from; unlabelled: rows (doc_id, text) whose votes
    fit the label model, all of them, and whose posteriors train the classifier. The labelled rows and the rows of the
    classifier are bounded samples (documented parameters); only counts of vote patterns and listed terms reach the
    driver.

    Null texts, null ids and labels other than 0 and 1 don't count. If either label is missing, or no text is there to
    vote on, there is no classifier, and every score is 0."""
    labelled = sampled(labelled.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("label").isin(0, 1)), max_labelled)
    rows = written(docs_of(labelled, F.col("label").cast("int").alias("label")), "labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    voters = Voters.of(mined(rows, toxic, clean) if toxic and clean else {})
    if not toxic or not clean:
        return Toxicity(voters, None, None)
    every = docs_of(unlabelled.filter("text is not null"))
    counted = every.mapInArrow(_vote_rows(voters), "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    patterns = [(r["votes"], r["n"]) for r in counted.orderBy("votes").collect()]  # two votes a voter, so 2 to their number at most
    if not patterns:
        return Toxicity(voters, None, None)
    model = label_model([p for p, _ in patterns], [n for _, n in patterns])
    seen = docs_of(sampled(unlabelled.filter("doc_id is not null and text is not null"), max_rows))
    seen = written(seen.mapInArrow(_example_rows(voters, model), "posterior double, slots array<int>"), "examples")
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight"))))
    soft = seen.select("slots", both.alias("x")).select("x.label", "x.weight", _vector("slots").alias("features")).filter("weight > 0.001")
    if soft.select("label").distinct().count() < 2:
        return Toxicity(voters, model, None)
    learned = LogisticRegression(weightCol="weight", regParam=0.001, elasticNetParam=0.5, maxIter=60).fit(soft)
    return Toxicity(voters, model, learned.coefficients.toArray(), float(learned.intercept))


def scored(docs: DataFrame, model: Toxicity, *keep: str) -> DataFrame:
    """doc_id, the columns keep, score (0 to 1) and predicted (1 if score >= 0.5) for every document.

    Whole texts; null and empty texts get the score of no word; repeated rows score alike, null ids pass through. A
    kept column that is named like an output comes out with _in after its name."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches(it):
            if model.weights is None:
                score = np.zeros(batch.num_rows)
            else:
                x = np.array([model.weights[at].sum() for at in slots(texts_of(batch, "_text"), terms)]) + model.bias
                score = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
            out = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "score", "predicted"])

    rows, schema = carried(docs, keep, ["score", "predicted"])
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
