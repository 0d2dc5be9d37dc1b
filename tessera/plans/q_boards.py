"""Registered sudoku and maze queries (S3, S4, G11-G13, A3, A4) on F3/F4."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.functions.rng import h
from tessera.operators import boards as BD
from tessera.plans import fixtures as FX
from tessera.plans import sqlexpr as X
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import SEED

N_SHUFFLE, MIN_RATING = 4, 3

SUDOKU_SQL = f"""
rel AS (SELECT o_orderkey, {X.random_perm(9, SEED, "'relabel'", 'o_orderkey')} AS p FROM orders),
sol AS (SELECT o_orderkey, list_transform(range(81), lambda i: p[(3 * ((i // 9) % 3) + i // 27 + i % 9) % 9 + 1] + 1) AS a,
               {X.digest(SEED, "'blank'", 'o_orderkey', '0')} || {X.digest(SEED, "'blank'", 'o_orderkey', '1')} || {X.digest(SEED, "'blank'", 'o_orderkey', '2')} AS m
        FROM rel),
sudoku AS (
  SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS source, o_orderkey,
         array_to_string(list_transform(a, lambda x, i: CASE WHEN instr('02468ace', substr(m, i, 1)) > 0
                                                     THEN '.' ELSE CAST(x AS VARCHAR) END), '') AS q,
         array_to_string(a, '') AS a, CAST(o_orderkey % 10 AS INTEGER) AS rating
  FROM sol)"""


def _band_sql(d, first):
    return X.let(X.perm_from_hex(d, first, 3), lambda b: (
        f"flatten(list_transform(range(3), lambda bi: list_transform("
        f"{X.perm_from_hex(d, f'{first + 3} + bi * 3', 3)}, lambda r: {b}[bi + 1] * 3 + r)))"))


def _shuffle_sql(cells):
    k = "(rows_[i // 9 + 1] * 9 + cols_[i % 9 + 1])"
    kk = f"(CASE WHEN tr THEN ({k} % 9) * 9 + {k} // 9 ELSE {k} END)"
    return f"list_transform(range(81), lambda i: dm[{cells}[{kk} + 1] + 1])"


@register("sudoku_augment", f"""WITH {SUDOKU_SQL},
parsed AS (SELECT o_orderkey, source, list_transform(string_split(replace(q, '.', '0'), ''), lambda x: CAST(x AS INTEGER)) AS qc,
                  list_transform(string_split(a, ''), lambda x: CAST(x AS INTEGER)) AS ac,
                  {X.h(SEED, "'split'", 'o_orderkey')} % 10 < 8 AS is_train
           FROM sudoku WHERE rating >= {MIN_RATING}),
e AS (SELECT parsed.*, CAST(unnest(CASE WHEN is_train THEN range({N_SHUFFLE + 1}) ELSE [0] END) AS INTEGER) AS aug_idx FROM parsed),
dg AS (SELECT e.*, {X.key_digits(BD.N_KEYS, SEED, "'shuffle'", 'o_orderkey', 'aug_idx')} AS dg FROM e),
d AS (SELECT dg.*, list_concat([0], list_transform({X.perm_from_hex('dg', BD.DIGIT_KEYS, 9)}, lambda x: x + 1)) AS dm,
             instr('13579bdf', substr(dg, {BD.FLIP_KEY * 8 + 1}, 1)) > 0 AS tr,
             {_band_sql('dg', BD.ROW_KEYS)} AS rows_, {_band_sql('dg', BD.COLUMN_KEYS)} AS cols_ FROM dg),
s AS (SELECT source, aug_idx, CASE WHEN aug_idx = 0 THEN qc ELSE {_shuffle_sql('qc')} END AS q2,
             CASE WHEN aug_idx = 0 THEN ac ELSE {_shuffle_sql('ac')} END AS a2 FROM d)
SELECT source, aug_idx, array_to_string(list_transform(q2, lambda x: x + 1), ',') AS inputs,
       array_to_string(list_transform(a2, lambda x: x + 1), ',') AS labels FROM s""")
def sudoku_augment(spark, sf_dir):
    """F3 + S3 (rating >= 3) + A3/G11 (4 shuffles per train board) + G13 (+1 tokens)."""
    s = BD.parse_sudoku(FX.sudoku_rows(spark, sf_dir), MIN_RATING)
    s = s.withColumn("o_orderkey", F.substring("source", 2, 20).cast("long")) \
         .withColumn("is_train", h(SEED, "split", F.col("o_orderkey")) % 10 < 8)
    a = BD.augment_sudoku_vectorised(s, N_SHUFFLE, SEED, "o_orderkey")
    return a.select("source", "aug_idx", F.array_join(G.digits_to_ids(F.col("q_cells"), 1), ",").alias("inputs"),
                    F.array_join(G.digits_to_ids(F.col("a_cells"), 1), ",").alias("labels"))


MAZE_SQL = f"""
mz0 AS (SELECT page_id, list_transform(range(100), lambda i: substr('{FX.MAZE_CHARSET}', CAST((unicode(substr(t, CAST(i * length(t) // 100 + 1 AS INTEGER), 1)) + i) % 5 + 1 AS INTEGER), 1)) AS qc
        FROM (SELECT page_id, concat_ws(' ', '', url, html) AS t FROM pages)),
maze AS (SELECT 'p' || CAST(page_id AS VARCHAR) AS source, array_to_string(qc, '') AS q,
                array_to_string(list_transform(qc, lambda x, i: CASE WHEN x = ' ' AND {X.h(SEED, "'path'", 'page_id', 'i - 1')} % 3 = 0 THEN 'o' ELSE x END), '') AS a
         FROM mz0)"""


def _ids_grid_sql(col):
    return (f"list_transform(range(10), lambda r: list_transform(range(10), lambda c: "
            f"CAST(instr('{FX.MAZE_CHARSET}', substr({col}, r * 10 + c + 1, 1)) AS INTEGER)))")


@register("maze_augment", f"""WITH {MAZE_SQL},
g AS (SELECT source, {_ids_grid_sql('q')} AS qg, {_ids_grid_sql('a')} AS ag FROM maze),
e AS (SELECT g.*, CAST(t.tid AS INTEGER) AS aug_idx FROM g, range(8) t(tid))
SELECT source, aug_idx, array_to_string(flatten({X.dihedral('qg', 'aug_idx')}), ',') AS inputs,
       array_to_string(flatten({X.dihedral('ag', 'aug_idx')}), ',') AS labels FROM e""")
def maze_augment(spark, sf_dir):
    """F4 + S4 + G12 (charset ids) + A4 (8 dihedral images)."""
    m = BD.augment_maze(FX.maze_rows(spark, sf_dir), 10, FX.MAZE_CHARSET)
    return m.select("source", "aug_idx", F.array_join("inputs", ",").alias("inputs"), F.array_join("labels", ",").alias("labels"))
