"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flightlake.llm import (
    decontaminate,
    extraction,
    filter_audit,
    language,
    licenses,
    line_dedup,
    mixing,
    near_duplicates,
    packing,
    phrases,
    quality,
    token_files,
    toxicity,
)
from flightlake.llm.common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_of(read_table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("text_hash")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated_lines(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(read_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality.quality(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *base, "base_failed", "kept", "quality")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.languages(docs).select("row.doc_id", "held_out", "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_token_files": op3_token_files,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_extraction": op6_extraction,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language": op10_language,
    "op11_filter_audit": op11_filter_audit,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_source_mixing": op13_source_mixing,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE,
    "op2_decontamination": decontaminate.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_phrase_mining": phrases.ORACLE,
    "op13_source_mixing": mixing.ORACLE,
}
