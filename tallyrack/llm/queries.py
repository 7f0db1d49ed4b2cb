"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import byte_pairs, decontamination, license_scans, near_duplicates, secret_scans, sentencepieces, source_audit, token_counts, token_files, toxicity, vector_codes, vector_links, warc_archives
from .common import table, tokenizer_path


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoding_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_rows(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"), least=0.8)
    return found.select("doc_id", "class_id", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archives.archive_rows(spark, table(spark, sf_dir, "pages"), least_bytes=0)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.find_secrets(table(spark, sf_dir, "documents"))


def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan_licences(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_rows(table(spark, sf_dir, "embeddings"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"), least_docs=3, top_terms=200)


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.encoding_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_secret_scans": op8_secret_scans,
    "op9_vector_links": op9_vector_links,
    "op10_license_scans": op10_license_scans,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_audit": op12_source_audit,
    "op13_byte_pairs": op13_byte_pairs,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op5_decontamination": decontamination.SQL, "op7_warc": warc_archives.SQL, "op11_vector_codes": vector_codes.SQL, "op12_source_audit": source_audit.SQL}
