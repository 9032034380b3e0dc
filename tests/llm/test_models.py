"""Quality, toxicity and language ID: held-out accuracy, and rows that are hard."""

import itertools
import math
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaphora.llm import language_id, quality, secrets, toxicity
from semaphora.llm.common import Words, mixed
from semaphora.llm.queries import language_id_query, quality_query, toxicity_query

from .helpers import empty, hard, words

MID = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = np.array(labels) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    rows = quality_query(spark, MID).filter("held_out").join(labels, "doc_id").collect()
    assert auc([r["expected_grade"] for r in rows], [r["quality"] for r in rows]) > 0.9
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.9


def test_ordinal_thresholds_are_in_order(spark):
    rows = [(i, " ".join([("bad", "fair", "good")[i % 3]] * (3 + i % 5)) + f" filler{i}", i % 3) for i in range(300)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, grade int"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    out = {r["doc_id"]: r for r in quality.graded(spark.createDataFrame([(0, "bad bad"), (1, "fair fair"), (2, "good good")], "doc_id long, text string"), model).collect()}
    assert out[0]["expected_grade"] < out[1]["expected_grade"] < out[2]["expected_grade"]
    assert all(r["tail"][0] >= r["tail"][1] and r["expected_grade"] == pytest.approx(sum(r["tail"])) for r in out.values())


def test_toxicity_held_out(spark):
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet")
    rows = toxicity_query(spark, large).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    figures = auc([r["score"] for r in held], [r["toxic"] for r in held]), np.mean([r["predicted"] == r["toxic"] for r in held])
    assert figures[0] > 0.9 and figures[1] > 0.95, figures


def simulated(n, seed=1):
    """Votes of voters of mixed polarity, some of which depend on others, and the labels."""
    draw = np.random.default_rng(seed)
    y = draw.random(n) < 0.2
    vote = lambda hit, false, value: np.where(draw.random(n) < np.where(y, hit, false), value, 0)
    a, b, c = vote(0.8, 0.02, 2), vote(0.6, 0.05, 2), vote(0.7, 0.03, 2)
    copies = np.where(draw.random(n) < 0.9, a, vote(0.8, 0.02, 2))  # mostly what the first says
    clean = np.where(a == 2, 0, np.where(draw.random(n) < np.where(y, 0.3, 0.95), 1, 0))  # speaks where a doesn't
    return np.stack([a, a, b, c, copies, clean], axis=1), y


def patterns_of(votes):
    text = ["".join("-01"[v] for v in row) for row in votes]
    return sorted(set(text)), [text.count(p) for p in sorted(set(text))]


def test_label_model_finds_accuracies_and_dependences():
    votes, y = simulated(6000)
    model = toxicity.label_model(*patterns_of(votes))
    assert model.prior == pytest.approx(0.2, abs=0.04)
    assert model.marginal[1][0][2] == pytest.approx(0.8, abs=0.08) and model.marginal[0][3][2] == pytest.approx(0.03, abs=0.03)
    around = {frozenset((i, int(p))) for i, p in enumerate(model.parent) if p >= 0}
    assert frozenset((0, 1)) in around or frozenset((1, 4)) in around and frozenset((0, 4)) in around
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.95


def test_posterior_by_enumeration():
    votes, _ = simulated(800, 3)
    model = toxicity.label_model(*patterns_of(votes))

    def joint(label, row):
        p = model.prior if label else 1 - model.prior
        for i, v in enumerate(row):
            p *= model.rates[label, i, row[max(model.parent[i], 0)], v]
        return p

    every = list(itertools.product(range(3), repeat=6))
    assert sum(joint(label, row) for label in (0, 1) for row in every) == pytest.approx(1)
    for row, p in zip(every[::7], model.posterior(np.array(every[::7])), strict=True):
        assert p == pytest.approx(joint(1, row) / (joint(0, row) + joint(1, row)), rel=1e-6)


def test_a_repeated_voter_adds_nothing():
    votes, _ = simulated(6000, 5)
    alone, twice = votes[:, [0, 2, 3, 5]], votes[:, [0, 1, 2, 3, 5]]
    p, q = (toxicity.label_model(*patterns_of(v)).posterior(v) for v in (alone, twice))
    assert np.abs(p - q).mean() < 0.02


def test_label_model_sees_every_row(spark):
    rows = [(i, ("vile grumf " if i % 5 == 0 else "kind words ") + f"about thing{i % 7}", int(i % 5 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    # toxic rows stand only where the least hashes don't reach
    unlabelled = labelled.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).filter("label = 0 or h > 400000000").select("doc_id", "text")
    few, every = (toxicity.fit(labelled, unlabelled, max_rows=n).labels for n in (40, 20_000))
    assert few.prior == every.prior and np.array_equal(few.rates, every.rates)


def test_votes_and_terms():
    terms = toxicity.Terms()
    h, kind, owner, _ = terms.of([b"Vile, vile grumfing", b"", None, b"horrible idiot"])
    assert [(int(k), int(o)) for k, o in zip(kind, owner, strict=True)] == [(0, 0)] * 3 + [(0, 3)] * 2 + [(1, 0), (1, 3), (1, 0), (1, 3)] + [(2, 0), (2, 0), (2, 3)]
    assert h[0] == h[1] and len(set(h)) == len(h) - 1
    mined = {0: h[[0, 2]], 1: h[[6]], 2: h[[9]]}  # vile, grumfing; horri; vile vile
    voters = toxicity.Voters.of(mined)
    texts = [b"so vile", b"vile vile", b"horribly vile idiot", b"fine", None, b"THIS IS VERY LOUD AND NOT KIND AT ALL OF YOU"]
    votes = ["".join("-01"[v] for v in row) for row in voters.votes(texts, terms)]
    # words, stems, pairs, four lists of insults, close, shouting, no word, stem, pair
    assert votes == ["1---------00", "1-1----1--0-", "11-111-1---0", "---------000", "---------000", "--------1000"]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    rows = language_id_query(spark, MID).filter("held_out").join(docs.filter("lang is not null"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swojej godności i swoich praw. Są oni obdarzeni rozumem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    ]
    foreign = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(other)], "doc_id long, text string, lang string")
    for langs in (["en"], ["en", "fr", "de", "es"]):
        filters = language_id.fit(docs.filter(F.col("lang").isin(langs)))
        own = docs.filter(F.col("lang").isin(langs) & F.col("text").rlike(r"\p{L}"))
        kept = language_id.accepted(own.union(foreign), filters)
        assert kept.filter("doc_id < 0").count() == 0 and kept.count() >= 0.99 * own.count()


def test_bloom_counts_are_corrected(spark):
    rows = [(i, ("the quick brown fox jumps" if i % 2 else "der schnelle braune fuchs springt") + f" {i}", "en" if i % 2 else "de") for i in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, score = model.predict(["the brown fox", "braune fuchs", "", "123 !!", None, "zzzz"])
    assert lang[:5] == ["en", "de", "und", "und", "und"] and lang[5] in ("en", "de") and all(0 <= s <= 1 for s in score)


def counted_by_sets(text, model, grams_of):
    """The n-grams of a text, one by one, and which languages' filters hold all of their slots."""
    hits = [0] * len(model.languages)
    for gram in grams_of(text):
        slots = [(gram >> 20 * i) % language_id.SLOTS for i in range(language_id.PROBES)]
        for k in range(len(hits)):
            hits[k] += all(int(model.masks[k // 64][s]) >> k % 64 & 1 for s in slots)
    return hits


def grams(text):
    """The same n-grams, said plainly: letters, runs of anything else as one blank, no blank inside."""
    clean = "".join(c if c.isalpha() else "\0" for c in text.lower())
    clean = "\0" + re.sub("\0+", "\0", clean.strip("\0")) + "\0" if clean.strip("\0") else ""
    for n in language_id.SIZES:
        for i in range(len(clean) - n + 1):
            part = clean[i : i + n]
            if "\0" not in part[1:-1]:
                h = n
                for c in part:
                    h = (h * 0x100000001B3 + (ord(c) if c != "\0" else 0)) % (1 << 64)
                yield int(mixed(np.array([h], dtype=np.uint64))[0])


def test_language_counts_by_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    texts = [r["text"][:300] for r in docs.filter("length(text) > 50").limit(12).collect()] + ["Ab c", "é! ü", "x"]
    found, has, total = model.counts(texts)
    for k, text in enumerate(texts):
        every = list(grams(text))
        want = [max(0, (h - len(every) * f) / (1 - f)) for h, f in zip(counted_by_sets(text, model, lambda _, e=every: e), model.false_positive, strict=True)]
        assert has[k] and total[k] == len(every) and found[k] == pytest.approx(want), text


def test_more_languages_than_a_word_has_bits(spark):
    rows = [(i * 10 + j, f"w{chr(97 + i % 26)}q{chr(97 + i // 26)} " * 3 + chr(0x4E00 + i) * 9, f"l{i:03d}") for i in range(150) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 150 and all(r["lang"] == r["lang_pred"] for r in language_id.identify(docs, model, "lang").collect())
    # the bound on rows leaves every language some
    assert len(set(language_id.fit(docs.union(docs.filter("lang = 'l000'").withColumn("doc_id", F.col("doc_id") + 5000)), max_docs=200).languages)) == 150


def test_quality_gradients_are_those_of_the_likelihood():
    t = np.array([-0.7, 0.4, 1.3])
    sigma = lambda x: 1 / (1 + math.exp(-x))

    def loss(q, t, grade):
        edges = [0.0, *(sigma(x - q) for x in t), 1.0]
        return -math.log(edges[grade + 1] - edges[grade])

    for grade in range(4):
        for q in (-2.0, 0.1, 1.7):
            dq, around = quality.gradients(q, grade, t)
            assert dq == pytest.approx((loss(q + 1e-6, t, grade) - loss(q - 1e-6, t, grade)) / 2e-6, abs=1e-5)
            for k in range(3):
                step = np.eye(3)[k] * 1e-6
                assert around.get(k, 0.0) == pytest.approx((loss(q, t + step, grade) - loss(q, t - step, grade)) / 2e-6, abs=1e-5)


def test_quality_tail_by_hand(spark):
    draw = np.random.default_rng(4)
    model = quality.Ordinal(draw.normal(size=quality.SIZE), np.array([-0.5, 0.5]))
    texts = ["a b a", "Some Words, here: 12\nsome words", "", None]
    rows = quality.graded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        own = [w.encode() for w in words(texts[r["doc_id"]])]
        (slots, values), = quality.features([(texts[r["doc_id"]] or "").encode()], Words())
        counts = Counter(int(Words().of([w])[0][0] % np.uint64(quality.SIZE)) for w in own)
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1.0
        q = sum(math.log1p(c) / norm * model.weights[s] for s, c in counts.items()) + 0.5 * sum(model.weights[s] for s in slots[len(counts):])
        assert len(values) == len(counts) + 12
        assert r["tail"] == pytest.approx([1 / (1 + math.exp(t - q)) for t in model.thresholds]) and r["expected_grade"] == pytest.approx(sum(r["tail"]))


def test_quality_repeats_itself_and_ignores_odd_grades(spark):
    rows = [(i, f"{('bad', 'good')[i % 2]} text number {i}", i % 2) for i in range(120)]
    odd = [(900, "never rated so", 7), (901, "nor so", -1), (902, "nor so", None), (None, "x", 1)]
    one, two = (quality.fit(spark.createDataFrame(r, "doc_id long, text string, grade int").repartition(n), 2) for r, n in ((rows, 3), (rows[::-1] + odd, 7)))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)


def test_clashing_names(spark):
    h = hard(spark)
    model = quality.Ordinal(np.zeros(quality.SIZE), np.zeros(2))
    assert quality.graded(h.withColumn("tail", F.lit(1)), model, "tail", "text").columns == ["doc_id", "tail_in", "text", "expected_grade", "tail"]
    filters = language_id.fit(h)
    out = language_id.identify(h, filters, "score", "lang_pred", "doc_id")
    assert out.columns == ["doc_id", "score_in", "lang_pred_in", "doc_id_in", "lang_pred", "score", "coverage"] and out.filter("score_in = 0.5").count() == 15
    tox = toxicity.Toxicity(toxicity.Voters.of({}), None, None)
    assert toxicity.scored(h, tox, "score").columns == ["doc_id", "score_in", "score", "predicted"]
    sure = {r["v_in"] for r in language_id.identify(h.withColumn("v_in", F.hash("doc_id", "text")), filters, "v_in").collect() if r["lang_pred"] != "und" and r["coverage"] >= 0.4}
    assert sure and sorted(map(str, language_id.accepted(h, filters).collect())) == sorted(map(str, h.filter(F.hash("doc_id", "text").isin(list(sure))).collect()))


def test_hard_rows(spark):
    h = hard(spark)
    model = quality.fit(h.withColumn("grade", F.when(F.col("doc_id") % 2 == 0, 0).when(F.col("doc_id") % 3 == 0, 1)), 2)
    rows = quality.graded(h, model, "v").collect()
    assert len(rows) == 17 and all(math.isfinite(r["expected_grade"]) for r in rows)
    assert quality.selected(h, model, 1, 0.0).count() == 17
    none = quality.fit(empty(spark).withColumn("grade", F.lit(1)), 3)
    assert [round(x, 3) for x in quality.graded(h, none).first()["tail"]] == [0.667, 0.333]
    filters = language_id.fit(h)
    assert language_id.identify(h, filters, "v").count() == 17
    kept = language_id.accepted(h, filters)
    assert kept.columns == h.columns and 0 not in {r["doc_id"] for r in kept.collect()}
    nothing = language_id.fit(empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(h, nothing).collect()} == {"und"}
    tox = toxicity.fit(h.withColumn("label", (F.col("doc_id") % 2).cast("int")), h)
    out = toxicity.scored(h, tox, "v").collect()
    assert len(out) == 17 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(h, toxicity.fit(empty(spark).withColumn("label", F.lit(1)), h)).count() == 17
    assert toxicity.scored(empty(spark), tox).count() == 0


def test_findings_are_read_once(spark, tmp_path):
    """The forest's many jobs do not work out the findings and their features again and again."""
    made = secrets.labelled_findings(spark, 400).coalesce(1).cache()

    def seen(batches):
        for batch in batches:
            if batch.num_rows:
                (tmp_path / uuid.uuid4().hex).touch()
            yield batch

    made.count()
    rows = made.coalesce(1).mapInArrow(seen, made.schema)
    assert secrets.train(rows) is not None
    assert len(list(tmp_path.iterdir())) == 1
    made.unpersist()
