import re

from pyspark.sql import functions as F

from semaphora.llm.common import id_bucket
from semaphora.llm import decontaminate, language_id

from .helpers import components, empty, hard, hard_rows
from .test_packing import check


def test_stages_against_brute_force(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = docs, docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, sf).cache()
        seen.append((before, kept))
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    assert all(out.columns == columns for _, out in seen[:4])
    first, second, third, fourth = (texts(out) for _, out in seen[:4])
    assert len(first) >= 0.95 * docs.filter("text is not null and text <> ''").count()
    label = components(first, 5, 80)
    assert set(second) == {k for k, v in label.items() if k == v}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(x in t for t in third.values() for x in items)
    assert set(fourth) == set(third) and not any("password=" in t and "password=[SECRET]" not in t for t in fourth.values())
    check(seen[4][1].collect(), fourth)
    assert corpus_pipeline.run(spark, sf).count() == seen[4][1].count()


def test_hard_rows(spark, sf, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names: what has words of a learned language stays."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    odd = hard(spark).withColumn("doc_id", F.col("doc_id") + 10**6)
    rows = odd.unionByName(docs, allowMissingColumns=True)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == rows.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in out} == ids
    assert not {10**6 + k for k, r in enumerate(hard_rows()[:13]) if not re.search("[a-zé漢]", r[1] or "")} & ids


def test_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
