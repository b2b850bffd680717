"""The corpus pipeline: five stages over the documents table, each written and read again.

Null, empty and blank texts have no letters, so the first stage drops them; the later ones take them as empty. Nulls in other columns are kept, and
columns that documents has besides its own pass through whatever they are called. Rows of different texts that share a
doc_id, or have none, are documents of their own; rows that repeat doc_id and text go or stay together. Ties are broken by the text's
hash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismata.llm import bpe, decontaminate, langid, linededup, simhash
from prismata.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model taught on the stage's own labelled rows can tell; without letters none can."""
    return langid.drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines go; documents stay, and n_chars follows the text."""
    return linededup.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one of smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in passages of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left."""
    return bpe.round_trip(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("decontaminate", benchmark), ("bpe", tokens)]

#: Language identification and tokens can't be expressed in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
