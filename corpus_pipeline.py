"""Corpus pipeline: documents to token ids, each stage written as Parquet and read again.

quality rules -> near duplicates -> benchmark decontamination -> mixing of
sources -> token ids. Every stage works on all that its predecessor kept. All
but the last return the columns of documents. Mixing drops nothing: its
decision is the order of the documents, which its files keep and the last stage
writes the token ids in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import decontaminate
from tessera.llm.mixing import mixed
from tessera.llm.near_dedup import deduplicated
from tessera.llm.quality import quality_filtered
from tessera.llm.queries import tokenizer_file
from tessera.llm.tables import load, stored
from tessera.llm.token_output import file_order, token_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds."""
    return quality_filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return deduplicated(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token ids, written as ORC in the order of the mixture and read back."""
    rows, order = file_order(docs)
    return token_table(rows, tokenizer_file(), order=order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]

#: token ids and near copies aren't for SQL; tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
