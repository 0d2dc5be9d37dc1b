"""Registered sampling / routing / splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sampling as R
from tessera.plans import fixtures as FX
from tessera.plans import sqlexpr as X
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import GRIDS, SEED, with_ctes

_HO = X.h(SEED, "o_orderkey")


@register("sample_exact", f"""
SELECT o_orderkey, o_custkey FROM orders ORDER BY {_HO}, o_orderkey LIMIT 1000""")
def sample_exact(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return R.sample_exact(o, 1000, SEED, "o_orderkey")


@register("shuffle_order", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {_HO}, o_orderkey) - 1 AS "order" FROM orders""")
def shuffle_order(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey")
    return R.shuffle_order(o, SEED, "o_orderkey")


@register("route_fraction", f"""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_HO}, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos / n < 0.8 THEN 'train' WHEN pos / n < 0.9 THEN 'val' ELSE 'test' END AS dest FROM o""")
def route_fraction(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey")
    return R.route_by_fraction(o, [(0.8, "train"), (0.9, "val")], SEED, "o_orderkey", default="test")


@register("route_role", with_ctes(GRIDS) + f""",
k AS (SELECT DISTINCT puzzle_id FROM pairs),
s AS (SELECT puzzle_id, row_number() OVER (ORDER BY {X.h(SEED, 'puzzle_id')}, puzzle_id) - 1 AS pos, count(*) OVER () AS n FROM k),
sub AS (SELECT puzzle_id, CASE WHEN pos / n < 0.75 THEN 'training' ELSE 'evaluation' END AS subset FROM s)
SELECT p.puzzle_id, p.ex_idx, sub.subset,
       CASE WHEN sub.subset = 'training' OR p.role = 'train' THEN 'train' ELSE 'test' END AS split,
       'all' AS set_name
FROM pairs p JOIN sub ON sub.puzzle_id = p.puzzle_id""")
def route_role(spark, sf_dir):
    """R3 per puzzle into subsets, then R4: evaluation puzzles give their demonstrations to train."""
    p = FX.grid_puzzles(spark, sf_dir)
    subsets = R.route_by_fraction(p.select("puzzle_id").distinct(), [(0.75, "training")], SEED, "puzzle_id",
                                  default="evaluation", name="subset")
    j = p.join(subsets, "puzzle_id")
    train = R.route_by_role(j.filter(F.col("subset") == "training"),
                            {"train": ("train", "all"), "test": ("train", "all")})
    evals = R.route_by_role(j.filter(F.col("subset") == "evaluation"),
                            {"train": ("train", "all"), "test": ("test", "all")})
    return train.unionByName(evals).select("puzzle_id", "ex_idx", "subset", "split", "set_name")


@register("train_test_split", f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY {X.h(SEED, 'doc_id')}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM d""")
def train_test_split(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents").select("doc_id")
    return R.train_test_split(d, 0.8, SEED, "doc_id")


@register("train_test_split_grouped", f"""
WITH g AS (SELECT DISTINCT l_orderkey FROM lineitem),
s AS (SELECT l_orderkey, row_number() OVER (ORDER BY {X.h(SEED, 'l_orderkey')}, l_orderkey) - 1 AS pos, count(*) OVER () AS n FROM g)
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN s.pos < floor(s.n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM lineitem l JOIN s ON s.l_orderkey = l.l_orderkey""")
def train_test_split_grouped(spark, sf_dir):
    """R5 with group=: every line of an order lands on the same side."""
    l = FX.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return R.train_test_split(l, 0.8, SEED, None, group="l_orderkey").select("l_orderkey", "l_linenumber", "split")


@register("pick_one", f"""
SELECT o_custkey, arg_min(o_orderkey, {{'k': {X.h(SEED, 'o_custkey', 'o_orderkey')}, 't': o_orderkey}}) AS picked
FROM orders GROUP BY o_custkey""")
def pick_one(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return R.pick_one_per_group(o, "o_custkey", SEED, "o_orderkey")


@register("pick_k", f"""
SELECT o_custkey, o_orderkey FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {X.h(SEED, 'o_custkey', 'o_orderkey')}, o_orderkey) AS rn
  FROM orders) WHERE rn <= 2""")
def pick_k(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return R.pick_k(o, "o_custkey", 2, SEED, "o_orderkey")
