"""A document pipeline out of the operators for training data.

Each stage takes what its predecessor kept: toxic documents go, of near-duplicates one stays,
documents that hold a benchmark item go, secrets are blanked out of the texts (the documents
stay), and what remains is encoded and decoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.llm import decontamination, near_duplicates, secret_scans, sentencepieces, toxicity
from tallyrack.llm.common import materialise, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs, least=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"), least=0.8)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = secret_scans.redact(docs)
    # the number of characters follows the text where it changed
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars")) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encoding_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", blank_secrets),
    ("sentencepiece", encode),
]

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
