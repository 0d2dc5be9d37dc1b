"""Cases that once gave wrong answers."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.operators import batching as B
from tessera.operators import text as TX
from tessera.operators import votes as V
from tessera.operators.ids import dense_id
from tessera.operators.sampling import pick_one_per_group
from tessera.operators.trace import ema_final
from tessera.sources import readers as S
from tessera.sources import sinks as K
from tessera.streaming import state as ST


def test_dense_ids_are_unique_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(0, 300_000, 1, 16).withColumn("x", F.rand(3))
        out = dense_id(df, ["x", "id"], name="n", num_partitions=16)
        got = out.agg(F.count_distinct("n").alias("d"), F.max("n").alias("m")).first()
        assert (got.d, got.m) == (300_000, 299_999)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("block", [None, 20000])
def test_packing_with_empty_puzzles(spark, block):
    sizes = spark.range(3000).select(F.col("id").alias("order"), F.when(F.col("id") % 20 == 0, 1).otherwise(0).alias("size"))
    got = B.pack_batches(sizes, 8, drop_last=False, block=block).collect()
    assert len(got) == 150 and {r.take for r in got} == {1}
    assert sorted(r.order for r in got) == list(range(0, 3000, 20))
    assert {r.batch_id for r in got} == set(range(19))


def test_stream_average_of_a_hot_key_and_restart(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "state")
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("k"), "id", ((F.col("id") * 37) % 1000).cast("double").alias("x"))
    rows.where("id < 12000").write.mode("append").parquet(src)

    def stream():
        return spark.readStream.schema("k long, id long, x double").parquet(src)
    first = ST.ema_to_table(stream(), spark, "k", ["id"], "x", 0.9, path=path).first()
    assert first.n == 12_000
    rows.where("id >= 12000").write.mode("append").parquet(src)
    again = ST.ema_to_table(stream(), spark, "k", ["id"], "x", 0.9, path=path).first()
    want = ema_final(rows, ["k"], ["id"], "x", 0.9).first()
    assert again.n == 30_000 and again.ema == pytest.approx(want.ema)
    # nothing new: the last version stands
    assert ST.ema_to_table(stream(), spark, "k", ["id"], "x", 0.9, path=path).first().ema == again.ema


def test_updated_table_keeps_old_keys_after_a_restart(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(2):
        spark.createDataFrame([(f"k{k}", 1)], "k string, x int").write.mode("append").parquet(src)
        counts = spark.readStream.schema("k string, x int").parquet(src).groupBy("k").agg(F.count("*").alias("n"))
        got = ST.run_to_table(counts, spark, "update", ["k"], path=path)
    assert {r.k: r.n for r in got.collect()} == {"k0": 1, "k1": 1}


def test_encode_without_unknown_token(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "id int, token string")
    docs = spark.createDataFrame([(1, "a b a"), (2, "")], "k int, t string")
    assert {r.k: r.ids for r in TX.encode(docs, ["k"], "t", vocab).collect()} == {1: [0, 1, 0], 2: []}
    with pytest.raises(Exception, match="unknown word"):
        TX.encode(docs.withColumn("t", F.lit("c")), ["k"], "t", vocab).collect()


def test_vocabulary_has_no_silent_cap(spark):
    corpus = spark.range(31_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    assert TX.build_vocab(corpus, ["[PAD]"]).count() == 31_001
    top = TX.build_vocab(corpus, ["[PAD]"], max_size=11)
    assert sorted(r.id for r in top.collect()) == list(range(11))


def test_builders_tell_columns_of_two_frames_apart(spark):
    a = spark.createDataFrame([(1, [[1, 2]])], "k int, g array<array<int>>")
    b = spark.createDataFrame([(1, [[3, 4]])], "k int, g array<array<int>>")
    ha, hb = a.select(G.grid_hash(a["g"]).alias("h")).first().h, b.select(G.grid_hash(b["g"]).alias("h")).first().h
    both = a.join(b, a["k"] == b["k"]).select(G.grid_hash(a["g"]).alias("x"), G.grid_hash(b["g"]).alias("y")).first()
    assert (both.x, both.y) == (ha, hb) and ha != hb


def test_picks_break_ties_by_whole_keys(spark):
    df = spark.createDataFrame([(1, 5), (1, 5 + (1 << 31)), (1, 5 + (1 << 40))], "g int, k long")
    assert {pick_one_per_group(df, "g", seed, "k").first().picked for seed in range(12)} == {5, 5 + (1 << 31), 5 + (1 << 40)}


def test_submission_quotes_names_and_keeps_unanswered_puzzles(spark, tmp_path):
    sub = spark.createDataFrame([('a"b', 0, 1, [[1]]), ('a"b', 0, 2, [[2]])], "name string, ex_idx int, attempt int, grid array<array<int>>")
    truth = spark.createDataFrame([('a"b', 0), ("none", 0)], "name string, ex_idx int")
    path = str(tmp_path / "sub")
    K.write_submission(V.submission_json(sub, truth), path)
    got = {}
    for r in spark.read.text(path).collect():
        got |= json.loads(r.value)
    assert got == {'a"b': [{"attempt_1": [[1]], "attempt_2": [[2]]}], "none": []}


def test_planning_strips_each_end_alone(spark, tmp_path):
    (tmp_path / "plan.csv").write_text('conditions,goals,all_qs,gt_qs,num_vars\n"frozenset({a\nb})",x),frozenset(y,frozenset({z}),3\n')
    (tmp_path / "domain.pddl").write_text("d")
    r = S.read_planning(spark, str(tmp_path / "plan.csv"), str(tmp_path / "domain.pddl")).first()
    assert (r.conditions, r.goals, r.all_qs, r.gt_qs) == ("{a\nb}", "x", "y", "{z}")


def test_package_reaches_the_workers_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
import __spark_entry__ as E
sys.path.pop(0)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", E.queries()["sudoku_augment"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
