"""Keyed state in the state store: several micro-batches, a restart in between, equal to batch."""

import os
import subprocess
import sys
import tempfile
import time

from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.trace import ema_final
from tessera.streaming import keyed as KS


def _tmp():
    return tempfile.mkdtemp(prefix="tessera-keyed-")


def test_ema_restart_equals_batch(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    ev = ev.withColumn("part", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    src, path = _tmp() + "/events", _tmp()
    rows = ev.drop("part")
    for parts in ((1, 2), (3,)):
        for p in parts:
            ev.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = KS.ema_by_key(stream, spark, "user_id", ["ts", "event_id"], "value", 0.9, path=path)
    got = {r.user_id: (round(r.ema, 6), r.n) for r in out.collect()}
    want = {r.user_id: (round(r.ema, 6), r.n) for r in ema_final(rows, ["user_id"], ["ts", "event_id"], "value", 0.9).collect()}
    assert got == want


def test_votes_are_cleared_by_the_next_evaluation(spark):
    schema = "name string, input_hash string, pred_hash string, q double, eval_id long"
    runs = [[[("p", "i", "A", 0.5, 1), ("p", "i", "B", 0.5, 1)], [("p", "i", "A", 0.7, 1)]],
            [[("p", "i", "A", 0.9, 2), ("p", "i", None, 0.1, 2)], [("p", "i", "A", 0.3, 2), ("p", "i", "A", 0.5, 2)]]]
    src, path = _tmp() + "/votes", _tmp()
    for n, files in enumerate(runs):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        got = {r.pred_hash: (r.eval_id, r.votes, round(r.mean_q, 6)) for r in KS.votes_by_evaluation(stream, spark, path).collect()}
        if n == 0:
            assert got == {"A": (1, 2, 0.6), "B": (1, 1, 0.5)}
    assert got == {"A": (2, 3, round(1.7 / 3, 6)), None: (2, 1, 0.1)}  # a timer took B away
    log = spark.read.parquet(f"{path}/out")
    last = log.agg(F.max("batch_id")).first()[0]
    assert log.filter((F.col("batch_id") == 1)).count() == 1 and last >= 3  # a batch writes the keys it changes


def test_votes_take_no_python_call_a_key(spark):
    """100,000 keys, nulls in every column but the evaluation: one Python call a key took minutes (F1)."""
    n = 100_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("p"), F.col("id") % 50)).alias("name"), F.col("id").cast("string").alias("input_hash"),
        F.lit("A").alias("pred_hash"), F.when(F.col("id") % 3 > 0, F.lit(0.5)).alias("q"))
    src, path = _tmp() + "/votes", _tmp()
    for e in (1, 2):
        both = rows.withColumn("eval_id", F.lit(e).cast("long"))
        both.unionByName(both.filter("input_hash % 2 = 0")).filter(f"input_hash % {e} = 0").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    begun = time.time()
    got = KS.votes_by_evaluation(stream, spark, path)
    seen = got.agg(F.count("*"), F.min("eval_id"), F.min("votes"), F.max("votes"), F.sum("mean_q")).first()
    assert tuple(seen)[:4] == (n // 2, 2, 2, 2) and abs(seen[4] - 0.5 * sum(i % 3 > 0 for i in range(0, n, 2))) < 1e-6
    assert time.time() - begun < 60


def test_a_stateful_processor_loads_where_the_package_is_not():
    sent = CloudPickleSerializer().dumps(KS.Ema("k", ["k"], "v", 0.9))
    code = "import pickle, sys; print(pickle.loads(sys.stdin.buffer.read()).mu)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=sent, cwd=tempfile.mkdtemp(), env=env, capture_output=True)
    assert done.stdout.split() == [b"0.9"], done.stderr
