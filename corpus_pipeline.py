"""Corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing, each on all its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but
the last return the columns of ``documents``.  Rows with nulls, empty texts, repeated
rows and extra columns pass through every stage by the rules of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalis.llm import decontam, langid, packing, secrets, simhash
from vitalis.llm.common import saved, table
from vitalis.llm.encode import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification, learned from ``docs`` outside of fold 2 of 4, doesn't reject."""
    return langid.known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with fewer than a twentieth of their words in passages of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark in the text and n_chars to match."""
    return secrets.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it (2048 tokens at most)."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]

STAGES: list[Stage] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", redaction),
    ("packing", sequences),
]

#: Language identification and tokenizers can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
