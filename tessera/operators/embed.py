"""Keyed embedding table operators (lookup, sparse delta sums, sign-SGD apply, mean reset)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BLOCK = 16  # fixed value: positions of a vector that are summed as one row


def lookup(ids: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows by id (equi-join)."""
    return ids.join(table, id_col)


def aggregate_deltas(deltas: DataFrame, id_col: str = "id", grad_col: str = "grad", round_to: int | None = None) -> DataFrame:
    """Element-wise sum of every delta per id.

    Grouped on (id, block of ``BLOCK`` positions), one sum a position, so a hot
    id is summed by partial aggregation in every task before the shuffle and a
    task's table holds one entry for a block, not one for each number. The
    vector, as long as the longest delta of its id, is put together from its blocks.
    """
    size = F.size(grad_col)
    e = deltas.where(size > 0).select(id_col, grad_col, size.alias("_n"))
    e = e.select(id_col, grad_col, "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / BLOCK).cast("int"))).alias("_b"))
    e = e.select(id_col, "_b", "_n", *[F.get(grad_col, F.col("_b") * BLOCK + i).alias(f"_g{i}") for i in range(BLOCK)])
    s = e.groupBy(id_col, "_b").agg(F.max("_n").alias("_n"), *[F.sum(f"_g{i}").alias(f"_g{i}") for i in range(BLOCK)])
    sums = [F.col(f"_g{i}") if round_to is None else F.round(f"_g{i}", round_to) for i in range(BLOCK)]
    s = s.select(id_col, F.struct("_b", F.array(*sums).alias("g"), "_n").alias("_s"))
    whole = s.groupBy(id_col).agg(F.array_sort(F.collect_list("_s")).alias("_v"))
    return whole.select(id_col, F.slice(F.flatten(F.transform("_v", lambda x: x["g"])), F.lit(1), F.array_max(F.transform("_v", lambda x: x["_n"]))).alias(grad_col))


def apply_sign_sgd(table: DataFrame, grads: DataFrame, lr: float, weight_decay: float,
                   id_col: str = "id", vec_col: str = "embedding", grad_col: str = "grad") -> DataFrame:
    """P <- p * (1 - lr * wd) - lr * sign(g) for touched ids; others unchanged."""
    j = table.join(grads, id_col, "left")
    upd = F.zip_with(vec_col, grad_col, lambda p, g: p * (1.0 - lr * weight_decay) - lr * F.signum(g))
    return j.select(id_col, F.when(F.col(grad_col).isNull(), F.col(vec_col)).otherwise(upd).alias(vec_col),
                    F.col(grad_col).isNotNull().alias("touched"))


def reset_to_mean(table: DataFrame, n_rows, vec_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """When the id count changes, every row of the new table is the column mean.

    The mean is one aggregated row (dim values); ``n_rows`` may be an int or a
    one-row DataFrame with column ``n``.
    """
    spark = table.sparkSession
    per_pos = table.select(F.posexplode(vec_col).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    mean = per_pos.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_v")) \
        .select(F.transform("_v", lambda s: s["m"]).alias(vec_col))
    if not isinstance(n_rows, int):
        n_rows = int(n_rows.collect()[0]["n"] or 0)  # one number
    ids = spark.range(n_rows).withColumnRenamed("id", id_col)  # generated across tasks
    return ids.crossJoin(F.broadcast(mean))  # one-row side
