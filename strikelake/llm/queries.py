"""One query per operator over its whole table: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strikelake.llm import (
    bwt_dedup, html_crf, lattice, merkle, middle, packing, parity_join, phrase_index, pii, quality, secrets, string_kernels, urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in every document."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_crf.extract(_table(spark, sf_dir, "pages"))


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier one has in strings of 50."""
    return bwt_dedup.report(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-copy class of every document."""
    return parity_join.classes(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and cascade verdict of every document."""
    return quality.quality_report(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of ``benchmark`` found in every document."""
    found = phrase_index.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return phrase_index.digest(found)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found in every document."""
    return pii.digest(pii.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return lattice.encode(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its copy, tampered with or not, folds to."""
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.tampered_chars())


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, bounds and hashes of every document's sample, and of the text made from it again."""
    return middle.digest(_table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    return string_kernels.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_main_text": op4_main_text,
    "op5_repeated_strings": op5_repeated_strings,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_personal_data": op9_personal_data,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language": op13_language,
}
