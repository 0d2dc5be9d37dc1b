"""Tables between the stages of an operator, and ranks inside large groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of rows that a Python worker gets at once, unless the session names a number
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` on batches of ``BATCH_BYTES``.

    By itself Spark makes batches of 10,000 rows, which for long texts take some
    hundred MB of a task and of its Python worker. Batches are cut when the plan
    runs, so the number stays set in the session.
    """
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that are stored inside go when the block ends, but for those with ``keep``.

    What leaves the block must not read them: store it with ``keep``.
    """
    path = shared_path(spark, name)
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``by`` names a column whose values get folders of their own.

    Cuts the lineage like ``checkpoint()`` and, unlike it, lets the planner see
    the size of the table, so that it is broadcast only if it is small.
    """
    inside = _scratch.get()
    path = f"{inside}/{name}-{uuid.uuid4().hex}" if inside and not keep else shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, buckets: int = 1024) -> DataFrame:
    """Add ``name``: the 0-based rank of each row in its group by ``order``.

    ``order`` starts with a column whose hex digits are spread evenly (a
    digest). A group is cut into ``buckets`` slices by the first digits, so one
    that holds a third of all rows is ranked by many tasks; the rows before a
    slice come from a table of at most ``buckets`` rows a group.
    """
    digits = 1
    while 16 ** digits < buckets:
        digits += 1
    key = F.substring(order[0], 1, digits)
    cut = df.withColumn("_slice", key)
    slices = cut.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    by = ", ".join(f"`{c}`" for c in group)
    before = slices.withColumn(
        "_before", F.expr(f"coalesce(sum(_n) over (partition by {by} order by _slice rows between unbounded preceding and 1 preceding), 0L)")
    ).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_slice").alias("_s"), "_before")
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group, "_slice").orderBy(*order)
    inside = cut.withColumn("_in", F.row_number().over(w) - F.lit(1))
    same = inside["_slice"] == before["_s"]
    for i, c in enumerate(group):
        same = same & inside[c].eqNullSafe(before[f"_g{i}"])
    return inside.join(before, same).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop(
        "_slice", "_in", "_before", "_s", *[f"_g{i}" for i in range(len(group))])
