import math
import os
from collections import Counter, defaultdict

import pytest

from semaphora.llm import language_model
from semaphora.llm.queries import language_model_query

from .helpers import empty, hard, words


def tokens(text):
    return [*words(text), None]


def brute_force(train, order):
    """Probabilities by the formulas, over dictionaries: p(context, token), token counts, distinct tokens."""
    counts, c1 = {n: Counter() for n in range(1, order + 1)}, Counter()
    for t in train:
        row = ["<s>"] * (order - 1) + tokens(t)
        c1.update(tokens(t))
        for i in range(order - 1, len(row)):
            counts[order][tuple(row[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):  # below the highest order: how many different words stand before
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discounts(values):
        n = Counter(values)
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))]

    off = {n: discounts(counts[n].values()) for n in counts}
    followers = {n: defaultdict(dict) for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            followers[n][g[:-1]][g[-1]] = c
    types, v = sum(counts[1].values()), len(c1)

    def p(context, w, n=order):
        own = followers[n].get(context[len(context) - n + 1 :] if n > 1 else ())
        if n == 1:
            c, d = (own or {}).get(w, 0), off[1]
            spread = sum(d[min(x, 3)] for x in (own or {}).values()) / types if types else 1.0
            return (max(c - d[min(c, 3)], 0) / types if types else 0) + spread / (v + 1)
        lower = p(context, w, n - 1)
        if not own:
            return lower
        c, total, d = own.get(w, 0), sum(own.values()), off[n]
        return max(c - d[min(c, 3)], 0) / total + sum(d[min(x, 3)] for x in own.values()) / total * lower

    return p, c1, v


TRAIN = ["the cat sat on the mat", "the dog sat on the log", "The cat ate the dog", "a a a a b", "b a b a", "", None, "the cat sat", "x y z x y x", "sat on the mat the cat"]


@pytest.mark.parametrize(("train", "order"), [(TRAIN, 2), (TRAIN * 3, 2), (["one"], 2), ([], 2), (TRAIN, 3), (TRAIN * 3, 3), ([], 3), (TRAIN, 4)])
def test_equals_brute_force(spark, train, order):
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    model = language_model.fit(docs, order)
    p, c1, v = brute_force(train, order)
    n = sum(c1.values())
    assert (model.tokens, model.words) == (n, v)
    ask = [*TRAIN, "quite new words", "the new cat"]
    rows = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(ask):
        own = ["<s>"] * (order - 1) + tokens(t)
        want = sum(math.log10(p(tuple(own[i - order + 1 : i]), own[i])) for i in range(order - 1, len(own)))
        own = tokens(t)
        assert rows[k]["score"] == pytest.approx(want, abs=1e-8)
        assert rows[k]["base_score"] == pytest.approx(sum(math.log10((c1[b] + 1) / (n + v + 1)) for b in own), abs=1e-8)
        assert (rows[k]["n_tokens"], rows[k]["n_known"]) == (len(own), sum(c1[b] > 0 for b in own))
    if train:
        for a in ("the", "<s>", "never"):
            context = ("<s>", "<s>", a)[-order + 1 :]
            assert sum(p(context, b) for b in c1) + p(context, "unseen") == pytest.approx(1)


def test_a_shard_that_cannot_be_read_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id long, text string")
    model = language_model.fit(docs)
    assert language_model.score(docs, model).first()["n_known"] == 7
    for name in os.listdir(model.folder):
        os.rename(f"{model.folder}/{name}", tmp_path / name)
    with pytest.raises(Exception, match="No such file"):
        language_model.score(docs, model).collect()


def test_shards_do_not_change_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ask = docs.limit(40)
    one, many = ({r["doc_id"]: r["score"] for r in language_model.score(ask, language_model.fit(docs, 3, n)).collect()} for n in (3, 40))
    assert one == pytest.approx(many)


def test_query_beats_unigrams_on_held_out_texts(spark, sf):
    rows = language_model_query(spark, sf).filter("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_hard_rows(spark):
    model = language_model.fit(hard(spark))
    rows = language_model.score(hard(spark), model).collect()
    assert len(rows) == 17 and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in rows)
    assert next(r["n_tokens"] for r in rows if r["doc_id"] == 0) == 1
    assert language_model.score(empty(spark), model).count() == 0
    out = language_model.score(hard(spark), model, "score", "text", "doc_id")
    assert out.columns == ["doc_id", "score_in", "text", "doc_id_in", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {r["score_in"] for r in out.collect()} == {0.5, None}
