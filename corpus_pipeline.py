"""A training corpus from ``documents``: five stages, each an operator of ``tarn.llm``, each written and read again.

Every stage decides on all rows that its predecessor kept. All but the last return the columns of ``documents``; the last
one adds ``copy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontaminate, mixing, near_copies, quality, secrets
from tarn.llm.shared import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base statistics or the decision list learned from ``labels`` reject."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts linked by a five-word Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of ``benchmark`` occurs."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts; every document stays."""
    return secrets.redact(docs, secrets.learn(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources reach their target weights."""
    return mixing.expand(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: SQL can't express the learned rules, the fingerprints or the models; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
