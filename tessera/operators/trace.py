"""T3-T5 (batch form): per-key moving average, halting step, continue target.

Ranks inside a key come from one global dense numbering in (key, order)
minus the key's first position: range partitioning spreads a hot key over
many tasks, unlike a window partitioned by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import sigmoid
from tessera.operators.ids import dense_id


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """0-based position of each row inside its key, in ``order`` (distributed)."""
    d = dense_id(df, keys + order, name="_gpos")
    first = d.groupBy(*keys).agg(F.min("_gpos").alias("_k0"), F.count("*").alias("_kn"))
    return d.join(first, keys).withColumn(name, F.col("_gpos") - F.col("_k0")) \
            .withColumnRenamed("_kn", "key_size").drop("_gpos", "_k0")


def ema_final(df: DataFrame, keys: list[str], order: list[str], value: str, mu: float) -> DataFrame:
    """s0 = x0, s <- (1 - mu) x + mu s over each key's rows in order; final s per key.

    Unrolled: s_final = mu^(n-1) x_0 + sum_{k>=1} (1 - mu) mu^(n-1-k) x_k, a
    weighted sum (grouped, partially aggregated) whose weights only shrink.
    """
    r = rank_within(df, keys, order)
    back = F.col("key_size") - 1 - F.col("rank")
    w = F.when(F.col("rank") == 0, F.pow(F.lit(mu), back)).otherwise((1.0 - mu) * F.pow(F.lit(mu), back))
    return r.groupBy(*keys).agg(F.sum(w * F.col(value)).alias("ema"), F.count("*").alias("n"))


def halt_step(max_steps: int, rule: str = "positive", explore: F.Column | None = None, min_steps: F.Column | None = None) -> F.Column:
    """T4 as an aggregate: first step (1-based) that is the last allowed one or wants to halt.

    rule 'positive': q_halt > 0; 'compare': q_halt > q_continue; 'never': only
    the last step halts (no adaptive halting). With exploration, a
    wanting-to-halt step only counts from ``min_steps`` on.
    """
    want = {"positive": F.col("q_halt") > 0, "compare": F.col("q_halt") > F.col("q_continue"), "never": F.lit(False)}[rule]
    if explore is not None:
        want = want & (~explore | (F.col("step") >= min_steps))
    return F.min(F.when((F.col("step") >= max_steps) | want, F.col("step")))


def halt_steps(trace: DataFrame, seq: list[str], max_steps: int, rule: str = "positive",
               explore: F.Column | None = None, min_steps: F.Column | None = None) -> DataFrame:
    """T4: ``halt_step`` of every sequence."""
    return trace.groupBy(*seq).agg(halt_step(max_steps, rule, explore, min_steps).alias("halt_step"))


def continue_target(trace: DataFrame, seq: list[str], max_steps: int) -> DataFrame:
    """T5: sigmoid(next q_halt) at the last allowed step, else sigmoid(max(next q_halt, next q_continue)).

    'Next' is the row at step + 1 of the same sequence (equi-join, not a
    window); without it the target is null.
    """
    nxt = trace.select(*seq, (F.col("step") - 1).alias("step"), F.col("q_halt").alias("n_halt"),
                       F.col("q_continue").alias("n_cont"))
    j = trace.join(nxt, seq + ["step"], "left")
    tgt = F.when(F.col("step") >= max_steps, F.col("n_halt")).otherwise(F.greatest("n_halt", "n_cont"))
    return j.select(*seq, "step", sigmoid(tgt).alias("target_q_continue"))
