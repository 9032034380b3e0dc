"""The thin queries over the tables: one for each operator, with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, language_id, language_model, main_text, merkle, near_dedup, packing, pii, quality, search, secrets, toxicity
from .sql import MERKLE_SQL, NEAR_DEDUP_SQL, SEARCH_SQL
from .common import id_bucket, table

#: The key of the pseudonyms of the query; give your own, secret one to the operator.
DEMO_KEY = "not a secret"
FOLD, LM_FOLD, LM_HELD_OUT = 5, 7, 2


def tokenizer_path() -> str:
    """The vocabulary file of the packing query: of the installed package of public tokenizers, where it lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _held_out() -> F.Column:
    return (id_bucket("doc_id", FOLD) == 0).alias("held_out")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(id_bucket("doc_id", FOLD) != 0)
    return docs.join(labels, F.col("doc_id") == F.col("_id")).drop("_id")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: 0 low quality, 1 good prose that is toxic, 2 good prose that is not; rows that lack the label that a
    rating needs are not rated. kept: at least grade 1 is likelier than not."""
    good = F.col("quality") == 1
    grade = F.when(F.col("quality") == 0, 0).when(good & (F.col("toxic") == 1), 1).when(good & (F.col("toxic") == 0), 2)
    model = quality.fit(_labelled(spark, sf_dir).select("doc_id", "text", grade.alias("grade")), 3)
    rows = quality.graded(table(spark, sf_dir, "documents"), model)
    tail = [F.col("tail")[k].alias(name) for k, name in enumerate(("p_good", "p_best"))]
    return rows.select("doc_id", _held_out(), "expected_grade", *tail, (F.col("tail")[0] >= 0.5).alias("kept"))


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.findings(table(spark, sf_dir, "documents"), model, "source").drop("text_key")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir).select("doc_id", "text", F.col("toxic").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(labelled, docs.filter(id_bucket("doc_id", FOLD) != 0))
    return toxicity.scored(docs, model).select("doc_id", _held_out(), "score", "predicted")


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.fit(docs.filter(id_bucket("doc_id", FOLD) != 0).select("doc_id", "text", "lang"))
    return language_id.identify(docs, filters).select("doc_id", _held_out(), "lang_pred", "score")


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarised(table(spark, sf_dir, "documents"), DEMO_KEY)


def language_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_bucket("doc_id", LM_FOLD) == LM_HELD_OUT
    model = language_model.fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    rows = language_model.score(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering, where 3 divides the crc32 of the id, lower-cases A-Z of the text."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    tampered = merkle.row_digest([*(F.col(c) for c in columns[:-1]), lowered])
    return merkle.manifest(docs, columns, now=F.when(id_bucket("doc_id", 3) == 0, tampered))


def main_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(spark, sf_dir, "pages"))


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality_query, "op2_near_dedup": near_dedup_query, "op3_packing": packing_query, "op4_secrets": secrets_query, "op5_toxicity": toxicity_query,
        "op6_language_id": language_id_query, "op7_fingerprint": fingerprint_query, "op8_pii": pii_query, "op9_language_model": language_model_query, "op10_decontamination": decontamination_query,
        "op11_merkle": merkle_query, "op12_main_text": main_text_query, "op13_search": search_query, "pipeline": pipeline_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": NEAR_DEDUP_SQL, "op11_merkle": MERKLE_SQL, "op13_search": SEARCH_SQL}
