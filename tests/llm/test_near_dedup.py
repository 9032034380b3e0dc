import random

from semaphora.llm import near_dedup
from semaphora.llm.queries import near_dedup_query

from .helpers import components, empty, hard, shingles


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = components(texts, 4, 80)
    for r in near_dedup_query(spark, sf).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(texts[r["doc_id"]], 4)), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_chains_and_borderline_links(spark):
    draw = random.Random(3)
    texts, k = {}, 0
    for _ in range(12):
        base = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        for _ in range(12):
            texts[k] = " ".join(base)
            k += 1
            base[draw.randrange(60)] = f"x{draw.randrange(10**6)}"
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == components(texts, 4, 80)


def test_hard_rows(spark):
    rows = near_dedup.near_duplicates(hard(spark)).collect()
    assert len(rows) == 17
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == 0 and by[0]["kept"] and by[1]["kept"]
    assert by[6]["component_id"] == by[7]["component_id"] == by[5]["component_id"] == 5
    out = near_dedup.deduplicated(hard(spark))
    assert out.columns == hard(spark).columns and {5, None} <= {r["doc_id"] for r in out.collect()}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """They are one document: what is linked with one of its texts is linked with it."""
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(5, one), (5, two), (3, one), (9, two), (7, "quite another text of its own")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]
    assert sorted(r["doc_id"] for r in near_dedup.deduplicated(docs).collect()) == [3, 7]


def test_a_hub_with_many_partners(spark):
    """More partners than meet a text in one place."""
    base = [f"w{k}" for k in range(120)]
    texts = {k: " ".join(base[:119] + [f"x{k}"]) for k in range(3 * near_dedup.MEMBERS)}
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert {r["component_id"] for r in rows} == {0} and len(rows) == len(texts)
