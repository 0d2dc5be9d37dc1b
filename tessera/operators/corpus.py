"""The grid corpus as one flow: augmentations, identifiers, token images, files, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.operators import augment as A
from tessera.operators import ids as D
from tessera.operators import sampling as R
from tessera.session import materialise
from tessera.sources import readers as S
from tessera.sources import sinks as K

ROWS_A_TASK = 1 << 14  # of two token images, 7 KB each: a task sorts 120 MB of them by split and set
SPEC = {"seq_len": 900, "vocab_size": 12, "pad_id": 0, "ignore_label_id": 0, "blank_identifier_id": 0}  # fixed values


def token_rows(examples: DataFrame, n_aug: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """A1 + G5 + D2 + R8 + G9 + G8. Returns (rows, identifiers).

    ``examples``: (puzzle_id, puzzle_name, split, ex_idx, input, output). Every
    kept augmentation of a puzzle becomes a puzzle of its group. In the train
    split all examples of a puzzle but one, drawn by seed, are translated.

    Rows meet their identifiers as grids and are dealt to as many tasks as their
    images need, as images compress so well that Spark would put very many into one.
    """
    group, _ = A.augment_puzzles(examples, n_aug, seed)
    aug = A.apply_augmentations(examples, group).withColumn("ex_idx", F.col("ex_idx").cast("int"))
    aug = materialise(aug.select("split", "puzzle_id", "aug_idx", "aug_name", "ex_idx", "aug_input", "aug_output"))
    identifiers = D.identifier_map(aug.select("aug_name", "puzzle_id", "aug_idx"), "aug_name", ["puzzle_id", "aug_idx"])
    rows = R.mark_exempt(aug, ["aug_name", "split"], seed, "ex_idx")
    size = [f(F.col(c)) for f in (G.height, G.width) for c in ("aug_input", "aug_output")]
    pad_r, pad_c = G.translation_offsets(seed, F.concat_ws(":", "aug_name", F.col("ex_idx").cast("string")), *size,
                                         exempt=F.col("exempt") | (F.col("split") != "train"))
    rows = rows.join(identifiers, F.col("aug_name") == F.col("puzzle_name")).drop("puzzle_name")
    tasks = max(aug.sparkSession.sparkContext.defaultParallelism, -(-aug.count() // ROWS_A_TASK))
    rows = rows.repartition(tasks, "aug_name", "split", "ex_idx")
    rows = rows.select("split", F.lit("all").alias("set_name"), F.col("puzzle_id").alias("group_id"), F.col("aug_name").alias("puzzle_id"), "ex_idx",
                       G.serialise(F.col("aug_input"), pad_r, pad_c).alias("inputs"), G.serialise(F.col("aug_output"), pad_r, pad_c).alias("labels"), "puzzle_identifier")
    return rows, identifiers


def build_corpus(examples: DataFrame, path: str, n_aug: int, seed: int) -> None:
    """Write dataset, metadata, identifiers and held-out puzzles (K1-K4) under ``path``."""
    rows, identifiers = token_rows(examples, n_aug, seed)
    K.write_dataset(rows, f"{path}/dataset")
    K.write_identifiers(identifiers, f"{path}/identifiers")
    kept = S.read_dataset(rows.sparkSession, [f"{path}/dataset"])
    spec = SPEC | {"num_puzzle_identifiers": (identifiers.agg(F.max("puzzle_identifier")).first()[0] or 0) + 1}
    K.write_metadata(D.build_metadata(kept, spec), f"{path}/metadata")
    K.write_puzzles_json(examples, f"{path}/test_puzzles", with_test_outputs=True)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S9 + S10 + metadata, joined: every row with its puzzle's name and its split's metadata.

    Names are the side that a task holds; token images pass by and are not sorted.
    """
    rows = S.read_dataset(spark, [f"{path}/dataset"])
    names = S.read_identifiers(spark, f"{path}/identifiers")
    meta = D.merge_metadata(S.read_metadata(spark, f"{path}/metadata"))
    return rows.join(names.hint("shuffle_hash"), "puzzle_identifier").join(F.broadcast(meta), "split")  # one row a split
