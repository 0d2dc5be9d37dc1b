"""Stream = batch: keyed state fed in many micro-batches equals the batch operators."""

import tempfile

from pyspark.sql import functions as F

from tessera.operators.trace import ema_final
from tessera.streaming import state as ST


def test_ema_many_batches_equals_batch(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    src = tempfile.mkdtemp(prefix="tessera-stream-") + "/events"
    # time-ordered files: each micro-batch holds a later slice of every user's events
    ev.withColumn("part", F.ntile(5).over(__import__("pyspark.sql").sql.Window.orderBy("ts", "event_id"))) \
        .write.partitionBy("part").parquet(src)
    files = spark.read.parquet(src)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(src)
    # the file source lists partitions in path order, so part=1 .. part=5 arrive in time order
    out = ST.ema_to_table(stream.drop("part"), spark, "user_id", ["ts", "event_id"], "value", 0.9)
    got = {r["user_id"]: (round(r["ema"], 6), r["n"]) for r in out.collect()}
    want = {r["user_id"]: (round(r["ema"], 6), r["n"]) for r in ema_final(ev, ["user_id"], ["ts", "event_id"], "value", 0.9).collect()}
    assert got == want


def test_vote_state_per_evaluation(spark):
    src = tempfile.mkdtemp(prefix="tessera-votes-") + "/preds"
    rows = [("p", "i", "A", 0.5, 1), ("p", "i", "A", 0.7, 1), ("p", "i", "A", 0.9, 2), ("p", "i", "B", 0.1, 2)]
    df = spark.createDataFrame(rows, "name string, input_hash string, pred_hash string, q double, eval_id int")
    df.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    agg = ST.run_to_table(ST.vote_state(stream, aggregated=True), spark, "complete")
    per = ST.run_to_table(ST.vote_state(stream, aggregated=False), spark, "complete")
    a = {(r["pred_hash"]): r["votes"] for r in agg.collect()}
    p = {(r["pred_hash"], r["eval_id"]): r["votes"] for r in per.collect()}
    assert a == {"A": 3, "B": 1}
    assert p == {("A", 1): 2, ("A", 2): 1, ("B", 2): 1}
