"""From raw documents to packed training sequences, one operator after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import decontamination, near_dups, pii, quality_rules
from rollcall.llm.packing import Limits, pack_documents
from rollcall.llm.tables import removed, scratch
from rollcall.sources import new_folder, table


def worthy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their host's frequent lines."""
    return quality_rules.filtered(docs)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dups.deduplicated(docs, length=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it generalised."""
    return pii.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, with their ids."""
    return pack_documents(docs, Limits(tokens=2048, segments=256, loss_tokens=2048), with_ids=True)


STAGES = [
    ("quality rules", worthy),
    ("near duplicates", single),
    ("decontamination", clean),
    ("personal data", sanitised),
    ("packing", packed),
]

#: Retrieval in a latent space and tokenising have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again.

    When a stage's output is written, its own tables and the output before it are removed.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = new_folder(spark, "pipeline"), []
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name.replace(' ', '-')}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        removed(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
