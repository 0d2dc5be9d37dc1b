"""T1-T3 and K7 as Structured Streaming jobs.

T1 vote state and T2 metric totals are streaming aggregations (state in the
state store, partial aggregation per micro-batch). T3 keeps one (ema, n) per
key in a table that each micro-batch merges into. Results go through
foreachBatch into tables under one path, in the shared checkpoint folder unless
the caller names one (never the driver), and stream checkpoints live there too:
a query that is started again on its path resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, tag: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-{tag}-{uuid.uuid4().hex[:12]}"


def vote_state(decoded: DataFrame, aggregated: bool = True) -> DataFrame:
    """Votes / mean q per (name, input_hash, pred_hash); with ``aggregated=False``
    each evaluation (eval_id) keeps its own state, i.e. votes are cleared per evaluation."""
    keys = ["name", "input_hash", "pred_hash"] + ([] if aggregated else ["eval_id"])
    return decoded.groupBy(*keys).agg(F.count("*").alias("votes"), F.avg("q").alias("mean_q"))


def metric_totals(scored: DataFrame, set_col: str = "set_name") -> DataFrame:
    """Running sums per set over every batch seen so far."""
    from tessera.operators.metrics import _sums
    return scored.groupBy(set_col).agg(*_sums(F.col("valid")))


def latest_version(spark: SparkSession, out: str) -> int | None:
    """Highest v<n> under ``out``, from the file system, so a restarted query knows it too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return max(done, default=None)


def _drain(stream: DataFrame, mode: str, sink, ckpt: str, timeout_s: int) -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception():
        raise q.exception()


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "complete",
                 keys: list[str] | None = None, timeout_s: int = 600, path: str | None = None) -> DataFrame:
    """Run a stream over everything available (availableNow) into a table, return it.

    complete: each batch is the whole result, a new version.
    update:   each batch holds changed keys (``keys``), which replace those of the version before.
    ``path`` holds table and stream checkpoint: a query started again on it goes
    on from its last version. A version belongs to a batch id, so a batch that
    is run again writes the same one.
    """
    path = path or scratch_path(spark, "stream")
    out = f"{path}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = [v for v in (latest_version(spark, out),) if v is not None]
        if mode == "update" and before:
            last = before[0] if before[0] < batch_id else batch_id - 1
            prev = spark.read.parquet(f"{out}/v{last}")
            batch = prev.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{out}/v{batch_id}")

    _drain(stream, mode, sink, f"{path}/checkpoint", timeout_s)
    last = latest_version(spark, out)
    if last is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{out}/v{last}")


def ema_to_table(stream: DataFrame, spark: SparkSession, key: str, order: list[str], value: str, mu: float,
                 timeout_s: int = 600, path: str | None = None) -> DataFrame:
    """T3 (stream): s <- (1 - mu) x + mu s per key, s0 = first value; (key, ema, n).

    The update is linear: a micro-batch with x_1 .. x_n takes s to
    mu^n s + sum of (1 - mu) mu^(n - i) x_i, with x_1 for s at a key's first
    batch. The sum is a grouped aggregate over ranks, so a key with any number
    of rows in a batch is summed by many tasks; the state is a table of one row
    a key. Rows are applied in ``order`` inside a batch; batches are taken to
    arrive in order, as a training log does.
    """
    from tessera.operators.trace import rank_within
    path = path or scratch_path(spark, "ema")
    out = f"{path}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = rank_within(batch.select(key, *[c for c in order if c != key], value), [key], order)
        weight = (1.0 - mu) * F.pow(F.lit(mu), (F.col("key_size") - 1 - F.col("rank")).cast("double"))
        new = rows.groupBy(key).agg(F.sum(weight * F.col(value)).alias("w"), F.count("*").alias("m"),
                                    F.max(F.when(F.col("rank") == 0, F.col(value))).cast("double").alias("x1"))
        last = latest_version(spark, out)
        last = None if last is None else last if last < batch_id else batch_id - 1
        if last is None or last < 0:
            old = spark.createDataFrame([], f"{key} {dict(batch.dtypes)[key]}, ema double, n long")
        else:
            old = spark.read.parquet(f"{out}/v{last}")
        both = old.join(new, key, "full")
        ema = F.when(F.col("m").isNull(), F.col("ema")).otherwise(
            F.pow(F.lit(mu), F.col("m").cast("double")) * F.coalesce("ema", "x1") + F.col("w"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        both.select(key, ema.alias("ema"), n.alias("n")).write.mode("overwrite").parquet(f"{out}/v{batch_id}")

    _drain(stream, "append", sink, f"{path}/checkpoint", timeout_s)
    last = latest_version(spark, out)
    if last is None:
        return spark.createDataFrame([], f"{key} {dict(stream.dtypes)[key]}, ema double, n long")
    return spark.read.parquet(f"{out}/v{last}")


def append_metrics(wide: DataFrame, path: str, step: int, keys: list[str], batch_id: int = 0) -> None:
    """K7: (keys..., metric, value) rows of a step in the metrics log; a batch that is written again replaces its rows."""
    from tessera.operators.metrics import long_format
    from tessera.sources.sinks import write_batch
    write_batch(long_format(wide, keys), path, step, batch_id)
