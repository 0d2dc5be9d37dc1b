"""T1, T3 with one state a key in the state store (RocksDB), written as a log of changes.

A micro-batch reads and writes only the keys it holds: each writes its new
state under ``out/batch_id=<n>``, and a batch that is run again replaces its
folder. ``latest`` gives the last state of every key. A query that is started
again on its path goes on with the states it had.

T1 here clears votes per evaluation. It is Spark's own aggregation, added up in
each task before the shuffle, with the evaluation as event time: once the next
evaluation has begun, the watermark clears the states of the one before, and
votes of it that come later are late and count for nothing. No Python code runs
for a key, so the time grows with the rows and not with calls for each key.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tessera.streaming.state import _drain, scratch_path

STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
VOTE_KEYS = ["name", "input_hash", "pred_hash"]

# Spark starts a Python process on the driver for a stateful processor, which may not see the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ddl(df: DataFrame, cols: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in cols)


class Ema(StatefulProcessor):
    """(ema, n) a key: s <- (1 - mu) x + mu s over the key's rows of a micro-batch, in their order."""

    def __init__(self, key: str, order: list[str], value: str, mu: float):
        self.key, self.order, self.value, self.mu = key, order, value, mu

    def init(self, handle) -> None:
        self.state = handle.getValueState("ema", "ema double, n long")

    def handleInputRows(self, key, rows, timerValues):
        x = pd.concat(list(rows)).sort_values(self.order)[self.value].to_numpy("float64")
        s, n = self.state.get() if self.state.exists() else (x[0], 0)
        weights = (1.0 - self.mu) * self.mu ** pd.RangeIndex(len(x) - 1, -1, -1).to_numpy("float64")
        s, n = float(self.mu ** len(x) * s + (weights * x).sum()), int(n + len(x))
        self.state.update((s, n))
        yield pd.DataFrame([(*key, s, n)], columns=[self.key, "ema", "n"])

    def close(self) -> None:
        pass


def _run(changes: DataFrame, spark: SparkSession, path: str, timeout_s: int) -> str:
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        _drain(changes, "update", sink, f"{path}/checkpoint", timeout_s)
    finally:
        spark.conf.set(STORE[0], before)
    return f"{path}/out"


def latest(spark: SparkSession, out: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The last change of every key in a log of changes."""
    values = [c for c in schema.names if c not in keys]
    log = spark.read.schema(StructType([*schema.fields]).add("batch_id", "long")).parquet(out)
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_s"))
    return last.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in values])


def votes_by_evaluation(decoded: DataFrame, spark: SparkSession, path: str | None = None, timeout_s: int = 600) -> DataFrame:
    """(name, input_hash, pred_hash, eval_id, votes, mean_q) of the last evaluation, from a stream of decoded
    predictions (name, input_hash, pred_hash, q, eval_id) whose evaluations arrive one after the other. A null q counts as 0."""
    path = path or scratch_path(spark, "votes")
    numbered = F.coalesce(F.col("eval_id").cast("long"), F.raise_error(F.lit("a vote without an evaluation")).cast("long"))
    # an evaluation is over when the next one has begun: half a second behind it, for whole evaluation numbers
    rows = decoded.withColumn("at", F.timestamp_seconds(numbered)).withWatermark("at", "500 milliseconds")
    q = F.col("q").cast("double")
    state = rows.groupBy(*VOTE_KEYS, "at").agg(
        F.count(F.lit(1)).alias("votes"), F.sum(F.when(q.isNull() | F.isnan(q), 0.0).otherwise(q)).alias("q_sum"))
    changes = state.select(*VOTE_KEYS, F.unix_seconds("at").alias("eval_id"), "votes", (F.col("q_sum") / F.col("votes")).alias("mean_q"))
    out = _run(changes, spark, path, timeout_s)
    newest = spark.read.schema(changes.schema).parquet(out).agg(F.max("eval_id").alias("eval_id"))  # one row
    last = latest(spark, out, changes.schema, [*VOTE_KEYS, "eval_id"])
    return last.join(F.broadcast(newest), "eval_id").select(changes.columns)


def ema_by_key(stream: DataFrame, spark: SparkSession, key: str, order: list[str], value: str, mu: float,
               path: str | None = None, timeout_s: int = 600) -> DataFrame:
    """(key, ema, n). A key's rows of a micro-batch are sorted in one task, so the trigger (files or bytes a
    batch) bounds them; ``state.ema_to_table`` sums a hot key's rows in many tasks."""
    path = path or scratch_path(spark, "ema-keyed")
    cols = list(dict.fromkeys([key, *order, value]))
    changes = stream.select(*cols).groupBy(key).transformWithStateInPandas(
        Ema(key, order, value, mu), f"{ddl(stream, [key])}, ema double, n long", "update", "None")
    return latest(spark, _run(changes, spark, path, timeout_s), changes.schema, [key])
