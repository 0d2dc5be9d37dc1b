"""Registered id / offset / metadata queries (D1-D7) on the F8 shape:
group = o_custkey, puzzle = o_orderkey, example = one lineitem row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ids as D
from tessera.plans import fixtures as FX
from tessera.plans import sqlexpr as X
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import SEED

_LORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate"]
_LORDER_SQL = ", ".join(_LORDER)


@register("dense_id", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (ORDER BY {_LORDER_SQL}) - 1 AS row_id
FROM lineitem""")
def dense_id(spark, sf_dir):
    l = FX.table(spark, sf_dir, "lineitem").select(*_LORDER)
    return D.dense_id(l, _LORDER, name="row_id").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "row_id")


@register("identifier_map", """
WITH f AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS puzzle_name, min({'d': o_orderdate, 'k': o_orderkey}) AS first
           FROM orders GROUP BY o_custkey)
SELECT CAST(row_number() OVER (ORDER BY first, puzzle_name) AS INTEGER) AS puzzle_identifier, puzzle_name FROM f""")
def identifier_map(spark, sf_dir):
    """First-appearance ids (by order date, then order key) for customer-level names, from 1."""
    o = FX.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("puzzle_name"), "o_orderdate", "o_orderkey")
    return D.identifier_map(o, "puzzle_name", ["o_orderdate", "o_orderkey"], start=1)


@register("csr_offsets", """
WITH s AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey)
SELECT row_number() OVER (ORDER BY l_orderkey) - 1 AS "index", l_orderkey, size,
       CAST(coalesce(sum(size) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(sum(size) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end"
FROM s""")
def csr_offsets(spark, sf_dir):
    l = FX.table(spark, sf_dir, "lineitem").select("l_orderkey")
    return D.csr_offsets(l, "l_orderkey").select("index", "l_orderkey", "size", "start", "end")


@register("interval_lookup", f"""
WITH s AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey),
iv AS (SELECT row_number() OVER (ORDER BY l_orderkey) - 1 AS idx,
              coalesce(sum(size) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
pt AS (SELECT row_number() OVER (ORDER BY {_LORDER_SQL}) - 1 AS pos FROM lineitem)
SELECT pt.pos, iv.idx AS "index" FROM pt ASOF JOIN iv ON pt.pos >= iv.start""")
def interval_lookup(spark, sf_dir):
    """Example position -> owning puzzle from CSR offsets (range join by buckets)."""
    l = FX.table(spark, sf_dir, "lineitem").select(*_LORDER)
    pts = D.dense_id(l, _LORDER, name="pos").select("pos")
    iv = D.csr_offsets(l.select("l_orderkey"), "l_orderkey").select("index", "start", "end")
    return D.lookup_interval(pts, "pos", iv, bucket=512).select("pos", "index")


_SPLIT_SQL = f"CASE WHEN {X.h(SEED, 'o_custkey')} % 10 < 8 THEN 'train' ELSE 'test' END"
_SPEC = {"pad_id": 0, "ignore_label_id": -100, "blank_identifier_id": 0, "vocab_size": 12, "seq_len": 900}


def _f8(spark, sf_dir):
    from tessera.functions.rng import h
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    l = FX.table(spark, sf_dir, "lineitem").select("l_orderkey")
    ex = l.join(o, l.l_orderkey == o.o_orderkey)
    return ex.select(F.when(h(SEED, F.col("o_custkey")) % 10 < 8, "train").otherwise("test").alias("split"),
                     F.lit("all").alias("set_name"), F.col("o_custkey").alias("group_id"),
                     F.col("o_orderkey").alias("puzzle_id"), "o_orderstatus")


_META_SQL = f"""
ex AS (SELECT {_SPLIT_SQL} AS split, 'all' AS set_name, o_custkey AS group_id, o_orderkey AS puzzle_id, o_orderstatus
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@register("metadata", f"""
WITH {_META_SQL}
SELECT split, count(DISTINCT group_id) AS total_groups, count(DISTINCT puzzle_id) AS total_puzzles,
       round(count(*) / count(DISTINCT puzzle_id), 6) AS mean_puzzle_examples, to_json(list_sort(list(DISTINCT set_name)))::VARCHAR AS sets,
       0 AS pad_id, -100 AS ignore_label_id, 0 AS blank_identifier_id, 12 AS vocab_size, 900 AS seq_len
FROM ex GROUP BY split""")
def metadata(spark, sf_dir):
    m = D.build_metadata(_f8(spark, sf_dir), _SPEC)
    return m.select("split", "total_groups", "total_puzzles", F.round("mean_puzzle_examples", 6).alias("mean_puzzle_examples"),
                    F.to_json("sets").alias("sets"), *_SPEC.keys())


@register("metadata_merge", f"""
WITH {_META_SQL},
m AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS path, split, count(DISTINCT group_id) AS g,
             count(DISTINCT puzzle_id) AS p, count(*) / count(DISTINCT puzzle_id) AS mean
      FROM ex GROUP BY 1, 2)
SELECT split, CAST(sum(g) AS BIGINT) AS total_groups, CAST(sum(p) AS BIGINT) AS total_puzzles, round(sum(mean * p) / sum(p), 6) AS mean_puzzle_examples,
       true AS consistent, CAST(floor(10 * sum(g) * sum(mean * p) / sum(p) / 768) AS BIGINT) AS total_steps
FROM m GROUP BY split""")
def metadata_merge(spark, sf_dir):
    """D6 + D7: metadata of two datasets (finished / open orders) merged per split; step plan."""
    ex = _f8(spark, sf_dir)
    a = D.build_metadata(ex.filter(F.col("o_orderstatus") == "F"), dict(_SPEC, num_puzzle_identifiers=0))
    b = D.build_metadata(ex.filter(F.col("o_orderstatus") != "F"), dict(_SPEC, num_puzzle_identifiers=0))
    merged = D.merge_metadata(a.unionByName(b))
    merged = D.plan_steps(merged, epochs=10, global_batch=768)
    return merged.select("split", F.col("total_groups").cast("long"), F.col("total_puzzles").cast("long"),
                         F.round("mean_puzzle_examples", 6).alias("mean_puzzle_examples"), "consistent", "total_steps")
