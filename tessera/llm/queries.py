"""Queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, importance, line_dedup, mixing, oracles
from tessera.llm.decontaminate import contamination
from tessera.llm.html_extract import extracted
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import packed
from tessera.llm.quality import judged
from tessera.llm.secrets import secret_digests
from tessera.llm.sharding import sharded
from tessera.llm.tables import load
from tessera.llm.token_alignment import alignment
from tessera.llm.token_output import token_table


def op1_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("row.doc_id", "found.n_words", "found.n_hit", "found.n_items", "found.items_sha256", "found.contaminated")


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(load(spark, sf_dir, "pages"))


def op3_site_relative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines that its site repeats."""
    return line_dedup.line_deduplicated(load(spark, sf_dir, "pages"))


def op4_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of every document in the mixture of sources."""
    return mixing.mixing_slots(load(spark, sf_dir, "documents"))


def op6_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    out = judged(load(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("row.doc_id", *[f"found.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      "verdict.base_failed", F.col("verdict.passed").alias("kept"))


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_digests(load(spark, sf_dir, "documents"), ["doc_id"])


def op8_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharded(load(spark, sf_dir, "documents"))


def op9_chat_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts are control strings, formatted and read back."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.formatted(rows.unionByName(made)))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files lie; the same path on every machine."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op10_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as ORC and read back."""
    return token_table(load(spark, sf_dir, "documents"), tokenizer_file())


def op11_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, written to buckets of equal lengths and read back."""
    return packed(load(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark."""
    return importance.resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the ids of two tokenizers in every document, and how common they are."""
    return alignment(load(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_decontamination": op1_suffix_array_decontamination,
    "op2_site_style_tree": op2_site_style_tree,
    "op3_site_relative_lines": op3_site_relative_lines,
    "op4_odd_sketch_near_dedup": op4_odd_sketch_near_dedup,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_adaptive_quality": op6_adaptive_quality,
    "op7_entropy_secrets": op7_entropy_secrets,
    "op8_lpt_sharding": op8_lpt_sharding,
    "op9_chat_fsm": op9_chat_fsm,
    "op10_orc_token_ids": op10_orc_token_ids,
    "op11_power_of_two_packing": op11_power_of_two_packing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_suffix_array_decontamination": oracles.decontamination(),
    "op3_site_relative_lines": line_dedup.ORACLE,
    "op4_odd_sketch_near_dedup": oracles.near_duplicates(),
    "op5_pfair_mixing": mixing.ORACLE,
    "op7_entropy_secrets": oracles.secrets(),
    "op9_chat_fsm": chat.oracle(),
    "op12_importance_resampling": importance.oracle(),
}
