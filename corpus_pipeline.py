"""A corpus from raw documents to packs: quality rules, quality classifier, near duplicates, secrets, packing.

Each stage takes what the one before kept, as a written Parquet table, and all but the last return the
columns of ``documents``. The rules and the classifier are fitted on the labelled rows of the source
tables, so that what an earlier stage rejected is still known as an example of junk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import jaccard_join, packing, quality_classifier, quality_rules, secrets
from quire.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.kept(docs, quality_rules.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds neither poor nor toxic."""
    return quality_classifier.kept(docs, quality_classifier.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all that have none."""
    return jaccard_join.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redacted(docs, secrets.scanner())


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs of neighbouring documents."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scans", without_secrets),
    ("packing", packs),
]

#: Forests, attention, automata and Hilbert keys aren't for SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs of the documents in ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
