"""S3/S4 parsing and G11, G12, A3, A4: sudoku and maze boards as Column programs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import grid as G

from tessera.functions.util import let


def parse_sudoku(df: DataFrame, min_difficulty: int | None = None) -> DataFrame:
    """S3: optional rating filter (pushed to the scan), '.' -> 0, digits -> array<int> of 81."""
    if min_difficulty is not None:
        df = df.filter(F.col("rating") >= min_difficulty)

    def digits(c):
        return F.transform(F.split(F.translate(c, ".", "0"), ""), lambda x: x.cast("int"))
    return df.withColumn("q_cells", digits(F.col("q"))).withColumn("a_cells", digits(F.col("a")))


#: keys of one draw: 0-8 digit map, 9 transpose (its first digit), 10-21 rows, 22-33 columns
DIGIT_KEYS, FLIP_KEY, ROW_KEYS, COLUMN_KEYS, N_KEYS = 0, 9, 10, 22, 34


def _band_order(d: Column, first: int) -> Column:
    """9 indices: 3 permuted bands (three keys), rows permuted inside each band (three keys each)."""
    from tessera.functions.rng import perm_from_hex
    bands = perm_from_hex(d, first, 3)
    return let(bands, lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda bi: F.transform(
        perm_from_hex(d, bi * 3 + first + 3, 3), lambda r: F.element_at(b, bi + 1) * 3 + r))))


def shuffle_params(seed, key, aug) -> Column:
    """One draw of G11's parameters."""
    from tessera.functions.rng import KEY_DIGITS, perm_from_hex

    def body(d):
        dm = F.concat(F.array(F.lit(0)), F.transform(perm_from_hex(d, DIGIT_KEYS, 9), lambda x: x + 1))
        t = F.instr(F.lit("13579bdf"), F.substring(d, FLIP_KEY * KEY_DIGITS + 1, 1)) > 0
        return F.struct(dm.alias("dm"), t.alias("t"), _band_order(d, ROW_KEYS).alias("rows"), _band_order(d, COLUMN_KEYS).alias("cols"))
    return let(shuffle_digest(seed, F.col(key) if isinstance(key, str) else key, aug), body)


def source_index(b: Column) -> Column:
    """For each of the 81 new cells, the 1-based old cell it reads (rows, cols, transpose)."""
    def src(i):
        k = F.element_at(b["rows"], F.floor(i / 9).cast("int") + 1) * 9 + F.element_at(b["cols"], ((i % 9) + 1).cast("int"))
        return (F.when(b["t"], (k % 9) * 9 + F.floor(k / 9).cast("int")).otherwise(k) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(80)), src)


def apply_mapping(cells: Column, src: Column, digit_map: Column) -> Column:
    return F.transform(src, lambda k: F.element_at(digit_map, F.element_at(cells, k) + 1))


def apply_shuffle(cells: Column, b: Column) -> Column:
    """G11 on an 81-vector with drawn parameters ``b`` (see shuffle_params)."""
    return apply_mapping(cells, source_index(b), b["dm"])


def sudoku_shuffle(cells: Column, seed, key, aug) -> Column:
    """Optional transpose, band/row and stack/column permutations, digit relabelling
    that keeps 0."""
    return let(shuffle_params(seed, key, aug), lambda b: apply_shuffle(cells, b))


def augment_sudoku(df: DataFrame, n: int, seed: int, key: str, train_col: str = "is_train") -> DataFrame:
    """A3: the original (aug 0) plus n shuffles for train boards; test boards only the original.
    Board and solution share one draw of the parameters (bound once per row)."""
    e = df.withColumn("aug_idx", F.explode(F.when(F.col(train_col), F.sequence(F.lit(0), F.lit(n)))
                                          .otherwise(F.array(F.lit(0)))))
    k, a = F.col(key), F.col("aug_idx")
    both = let(shuffle_params(seed, k, a), lambda b: let(source_index(b), lambda src: F.struct(
        apply_mapping(F.col("q_cells"), src, b["dm"]).alias("q"), apply_mapping(F.col("a_cells"), src, b["dm"]).alias("a"))))
    e = e.withColumn("_s", F.when(a == 0, F.struct(F.col("q_cells").alias("q"), F.col("a_cells").alias("a")))
                     .otherwise(both))
    return e.withColumn("q_cells", F.col("_s.q")).withColumn("a_cells", F.col("_s.a")).drop("_s")


def augment_maze(df: DataFrame, side: int, charset: str, do_aug: bool = True) -> DataFrame:
    """A4 + G12: all 8 dihedral images (id 0 first) when augmenting; chars -> 1-based ids."""
    ids_q = G.chars_to_ids(F.col("q"), charset)
    ids_a = G.chars_to_ids(F.col("a"), charset)
    d = df.withColumn("_qg", G.reshape(ids_q, side)).withColumn("_ag", G.reshape(ids_a, side))
    tids = F.sequence(F.lit(0), F.lit(7)) if do_aug else F.array(F.lit(0))
    d = d.withColumn("aug_idx", F.explode(tids))
    return d.withColumn("inputs", F.flatten(G.dihedral(F.col("_qg"), F.col("aug_idx")))) \
            .withColumn("labels", F.flatten(G.dihedral(F.col("_ag"), F.col("aug_idx")))).drop("_qg", "_ag")


# ---------------------------------------------------------------------------
# Vectorised G11: the same draws as shuffle_params/apply_shuffle, applied to
# whole Arrow batches with NumPy (the Column version interprets ~1000 lambda
# steps per board). Spark still partitions the rows; this is a per-batch helper.
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _hex_keys(d: np.ndarray, first: int, n: int) -> np.ndarray:
    """(rows, n) sort keys from the digits of keys ``first``, ``first + 1``, ..."""
    from tessera.functions.rng import KEY_DIGITS
    own = d[:, first * KEY_DIGITS:(first + n) * KEY_DIGITS].reshape(len(d), n, KEY_DIGITS)
    return own @ (16 ** np.arange(KEY_DIGITS - 1, -1, -1, dtype=np.int64))


def _perm(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys, axis=1, kind="stable")  # ties keep index order, as the sort on (key, i)


def _band_order_np(d: np.ndarray, first: int) -> np.ndarray:
    bands = _perm(_hex_keys(d, first, 3))
    parts = []
    for bi in range(3):
        inner = _perm(_hex_keys(d, first + 3 + bi * 3, 3))
        parts.append(bands[:, bi:bi + 1] * 3 + inner)
    return np.concatenate(parts, axis=1)


def shuffle_batch(digests: pa.Array, boards: list[pa.Array]) -> list[pa.Array]:
    """G11 for a batch: digests are the key digits of shuffle_params; each of ``boards`` has a row of 81 cells a digest."""
    from tessera.functions.rng import KEY_DIGITS
    raw = np.frombuffer("".join(digests.to_pylist()).encode(), dtype=np.uint8)
    d = np.searchsorted(_HEX, raw.reshape(len(digests), -1) if len(digests) else raw.reshape(0, N_KEYS * KEY_DIGITS))
    dm = np.concatenate([np.zeros((len(d), 1), dtype=np.int64), _perm(_hex_keys(d, DIGIT_KEYS, 9)) + 1], axis=1)
    t = (d[:, FLIP_KEY * KEY_DIGITS] % 2) == 1
    rows, cols = _band_order_np(d, ROW_KEYS), _band_order_np(d, COLUMN_KEYS)
    i = np.arange(81)
    k = rows[:, i // 9] * 9 + cols[:, i % 9]
    k = np.where(t[:, None], (k % 9) * 9 + k // 9, k)
    out = []
    for cells in boards:
        own = cells.flatten().to_numpy(zero_copy_only=False).reshape(len(d), 81)
        new = np.take_along_axis(dm, np.take_along_axis(own, k, axis=1), axis=1).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * 81, pa.int32()), pa.array(new.reshape(-1))))
    return out


def shuffle_digest(seed, key: Column, aug: Column) -> Column:
    from tessera.functions.rng import key_digits
    return key_digits(N_KEYS, seed, "shuffle", key, aug)


def augment_sudoku_vectorised(df: DataFrame, n: int, seed: int, key: str, train_col: str = "is_train") -> DataFrame:
    """A3 with the vectorised G11 (same output as augment_sudoku)."""
    e = df.withColumn("aug_idx", F.explode(F.when(F.col(train_col), F.sequence(F.lit(0), F.lit(n)))
                                          .otherwise(F.array(F.lit(0)))))
    schema = e.schema
    q, a, at = (schema.names.index(c) for c in ("q_cells", "a_cells", "aug_idx"))
    digests = F.when(F.col("aug_idx") > 0, shuffle_digest(seed, F.col(key), F.col("aug_idx")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            drawn = np.flatnonzero(columns[at].to_numpy() > 0)
            # originals stay as they are; shuffles lie behind them
            place = np.arange(batch.num_rows)
            place[drawn] = batch.num_rows + np.arange(len(drawn))
            new = shuffle_batch(batch.column(len(columns)).take(drawn), [columns[c].take(drawn) for c in (q, a)])
            for c, cells in zip((q, a), new, strict=True):
                columns[c] = pa.concat_arrays([columns[c], cells.cast(columns[c].type)]).take(place)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return e.withColumn("_digests", digests).mapInArrow(run, schema)
