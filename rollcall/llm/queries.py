"""The registered queries of this package: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import classifier, decontamination, fill_in_middle, hard_negatives, html_text, licenses, near_dups, pii, quality_rules, substring_dups, token_planes, warc
from rollcall.llm.packing import Limits, pack_documents
from rollcall.sources.tables import table


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that leaks into it."""
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    found = quality_rules.assessed(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every document by shingles of three words at 0.85."""
    return near_dups.near_duplicates(table(spark, folder, "documents"), length=3, percent=85)


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data and of disclosing terms in every document."""
    return pii.digest(pii.found(table(spark, folder, "documents")))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases and contained license templates of every document."""
    return licenses.licensed(table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, folder, "documents"), Limits(tokens=2048, segments=256, loss_tokens=2048))


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extracted(table(spark, folder, "pages"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from the labels of three quarters of the ids."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return classifier.scored(table(spark, folder, "documents"), table(spark, folder, "labels"), held_out)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    archives = warc.archive_folder(spark)
    records = warc.read(warc.write(table(spark, folder, "pages"), archives), archives)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at least 40 words of every document that repeat, also with edits, in an earlier one."""
    return substring_dups.repeated_passages(table(spark, folder, "documents"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut and rearranged for filling in the middle, and made whole again."""
    found = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    whole = fill_in_middle.restored(F.col("output"), F.col("form"))
    sha256 = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"), sha256(whole).alias("restored_sha256")
    )


def op12_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents written in ascending order as compressed planes, and read back."""
    planes = warc.archive_folder(spark)
    found = token_planes.read(token_planes.write(table(spark, folder, "documents"), planes), planes)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth id, against all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator."""
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality_rules": op2_quality_rules,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_pii": op4_pii,
        "op5_licenses": op5_licenses,
        "op6_packing": op6_packing,
        "op7_html_text": op7_html_text,
        "op8_quality": op8_quality,
        "op9_warc": op9_warc,
        "op10_substring_dups": op10_substring_dups,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_planes": op12_token_planes,
        "op13_hard_negatives": op13_hard_negatives,
    }
