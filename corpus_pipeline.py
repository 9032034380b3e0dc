"""A training corpus in five stages, each one an operator of semaphora.llm over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semaphora.llm import decontaminate, language_id, near_dedup, packing, secrets
from semaphora.llm.common import id_bucket, table, written
from semaphora.llm.queries import FOLD, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language go."""
    filters = language_id.fit(docs.filter(id_bucket("doc_id", FOLD) != 0).select("doc_id", "text", "lang"))
    return language_id.accepted(docs, filters)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays, the one of the smallest id."""
    return near_dedup.deduplicated(docs)


def unseen_by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that cover a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets are replaced in the texts; all documents stay."""
    return secrets.redacted(docs, secrets.train(secrets.labelled_findings(spark)), "source")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("language_id", known_language), ("near_dedup", one_of_each), ("decontamination", unseen_by_benchmark), ("secrets", without_secrets), ("packing", packed)]
#: No stage but near_dedup can be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what each stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
