"""Registered source/sink round trips (S1, S2, S9, S10, K1, K3, K4, K6) over data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.operators import votes as V
from tessera.plans import fixtures as FX
from tessera.plans import sqlexpr as X
from tessera.plans.registry import ORACLES, register
from tessera.plans.sqlfixtures import GRIDS, SEED, with_ctes
from tessera.sources import readers as S
from tessera.sources import sinks as K
from tessera.streaming.state import scratch_path


@register("json_roundtrip", with_ctes(GRIDS) + f"""
SELECT 'eval' AS subset, puzzle_name, role,
       CAST(row_number() OVER (PARTITION BY puzzle_name, role ORDER BY ex_idx) - 1 AS INTEGER) AS ex_idx, {X.grid_hash('input')} AS in_hash,
       {X.grid_hash('output')} AS out_hash, false AS missing_solution FROM pairs""")
def json_roundtrip(spark, sf_dir):
    """K4 writes challenges without test outputs plus a solutions file as JSON lines;
    S1 reads them back, S2 overlays the solutions."""
    puz = FX.grid_puzzles(spark, sf_dir)
    base = scratch_path(spark, "json")
    K.write_puzzles_json(puz, f"{base}/challenges", with_test_outputs=False)
    K.write_solutions_json(puz, f"{base}/solutions")
    back = S.read_grid_puzzles(spark, {"eval": f"{base}/challenges"})
    full = S.overlay_solutions(back, spark.read.text(f"{base}/solutions"))
    return full.select("subset", "puzzle_name", "role", "ex_idx", G.grid_hash(F.col("input")).alias("in_hash"),
                       G.grid_hash(F.col("output")).alias("out_hash"), "missing_solution")


@register("json_objects_split", ORACLES["json_roundtrip"])
def json_objects_split(spark, sf_dir):
    """S1 + S2 on objects of about 1,000 puzzles each: entries are found by many tasks, whatever the size of an object."""
    puz = FX.grid_puzzles(spark, sf_dir)
    base = scratch_path(spark, "objects")
    K.write_puzzles_json(puz, f"{base}/lines", with_test_outputs=False)
    K.write_solutions_json(puz, f"{base}/solution-lines")
    for name, out in (("lines", "challenges"), ("solution-lines", "solutions")):
        lines = spark.read.text(f"{base}/{name}")
        bucket = F.pmod(F.xxhash64("value"), F.lit(lines.count() // 1000 + 1))
        entry = F.expr("substring(value, 2, char_length(value) - 2)")
        objects = lines.groupBy(bucket).agg(F.array_join(F.collect_list(entry), ", ").alias("e"))
        objects.select(F.concat(F.lit("{"), "e", F.lit("}"))).write.text(f"{base}/{out}")
    back = S.read_grid_puzzles(spark, {"eval": f"{base}/challenges"}, whole_file=True)
    full = S.overlay_solutions(back, S.object_entries(spark, f"{base}/solutions", "]"))
    return full.select("subset", "puzzle_name", "role", "ex_idx", G.grid_hash(F.col("input")).alias("in_hash"),
                       G.grid_hash(F.col("output")).alias("out_hash"), "missing_solution")


_SPLIT = f"CASE WHEN {X.h(SEED, 'o_custkey')} % 10 < 8 THEN 'train' ELSE 'test' END"


@register("dataset_roundtrip", f"""
WITH ex AS (SELECT {_SPLIT} AS split, CASE WHEN o_orderstatus = 'F' THEN 'all' ELSE 'all1' END AS set_name,
                   o_custkey, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT set_name, count(*) AS n_examples, count(DISTINCT o_orderkey) AS n_puzzles, count(DISTINCT o_custkey) AS n_groups
FROM ex WHERE split = 'train' GROUP BY set_name""")
def dataset_roundtrip(spark, sf_dir):
    """K1 writes two built datasets (finished / other orders) partitioned by split and set;
    S9 reads the train split of both (second path's set renamed all1)."""
    from tessera.functions.rng import h
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    l = FX.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    ex = l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.when(h(SEED, F.col("o_custkey")) % 10 < 8, "train").otherwise("test").alias("split"),
        F.lit("all").alias("set_name"), F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("puzzle_id"),
        F.array(F.col("l_linenumber")).alias("inputs"), "o_orderstatus")
    base = scratch_path(spark, "ds")
    K.write_dataset(ex.filter(F.col("o_orderstatus") == "F").drop("o_orderstatus"), f"{base}/a")
    K.write_dataset(ex.filter(F.col("o_orderstatus") != "F").drop("o_orderstatus"), f"{base}/b")
    d = S.read_dataset(spark, [f"{base}/a", f"{base}/b"], "train")
    return d.groupBy("set_name").agg(F.count("*").alias("n_examples"), F.count_distinct("puzzle_id").alias("n_puzzles"),
                                     F.count_distinct("group_id").alias("n_groups"))


@register("identifiers_blank", ORACLES["identifier_map"] + """
UNION ALL SELECT 0, '<blank>'""")
def identifiers_blank(spark, sf_dir):
    """D2 + K3: identifiers with '<blank>' in every unused slot (here only 0), written and read back."""
    from tessera.plans.q_ids import identifier_map
    path = scratch_path(spark, "ids")
    K.write_identifiers(identifier_map(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("submission_json")
def submission_json(spark, sf_dir):
    """E10 + K6: per-puzzle submission documents {attempt_1, attempt_2} per answered pair."""
    preds, identifiers, puzzles = FX.grid_predictions(spark, sf_dir)
    votes = V.vote_table(V.decode_predictions(preds, identifiers), with_grid=True)
    truth = V.truth_table(puzzles)
    return V.submission_json(V.submission(votes, truth, 2), truth)
