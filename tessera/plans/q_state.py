"""Registered keyed-state queries: embeddings (N1-N4, F11) and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rng import h
from tessera.operators import embed as N
from tessera.operators import trace as T
from tessera.plans import fixtures as FX
from tessera.plans import sqlexpr as X
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import SEED

LR, WD, MU, MAX_STEPS = 0.1, 0.5, 0.9, 16

_EMB_SQL = """
t AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS emb FROM embeddings),
te AS (SELECT id, unnest(emb) AS p, CAST(unnest(range(len(emb))) AS INTEGER) AS pos FROM t)"""


@register("embed_update", f"""WITH {_EMB_SQL},
n AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT e.event_id % n.n AS id,
             list_transform(t.emb, lambda x: x * CASE WHEN e.event_type = 'error' THEN -1.0 ELSE 1.0 END) AS grad
      FROM events e, n JOIN t ON t.id = e.user_id % n.n),
dl AS (SELECT id, unnest(grad) AS g, CAST(unnest(range(len(grad))) AS INTEGER) AS pos FROM d),
s AS (SELECT id, pos, round(sum(g), 6) AS g FROM dl GROUP BY id, pos)
SELECT te.id, te.pos, round(CASE WHEN s.g IS NULL THEN te.p ELSE te.p * {1.0 - LR * WD!r} - {LR!r} * sign(s.g) END, 6) AS value
FROM te LEFT JOIN s ON s.id = te.id AND s.pos = te.pos""")
def embed_update(spark, sf_dir):
    """F11 + N1-N3: sparse deltas summed per id (rounded to 6), sign-SGD with decoupled decay; all rows, touched or not."""
    table, deltas = FX.embedding_deltas(spark, sf_dir)
    grads = N.aggregate_deltas(deltas, "id", "grad", round_to=6)
    upd = N.apply_sign_sgd(table, grads, LR, WD, "id", "embedding", "grad")
    return upd.select("id", F.posexplode("embedding").alias("pos", "v")).select("id", "pos", F.round("v", 6).alias("value"))


@register("embed_reset", f"""WITH {_EMB_SQL},
m AS (SELECT pos, avg(p) AS v FROM te GROUP BY pos),
n AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT r.id, m.pos, round(m.v, 6) AS value FROM m, n, (SELECT unnest(range((SELECT n FROM n))) AS id) r""")
def embed_reset(spark, sf_dir):
    """A new table with one row per distinct user, every row the column mean."""
    table, _ = FX.embedding_deltas(spark, sf_dir)
    n = FX.table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n"))
    r = N.reset_to_mean(table, n)
    return r.select("id", F.posexplode("embedding").alias("pos", "v")).select("id", "pos", F.round("v", 6).alias("value"))


@register("ema_per_key", f"""
SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: {1.0 - MU!r} * x + {MU!r} * s), 6) AS ema,
       count(*) AS n
FROM events GROUP BY user_id""")
def ema_per_key(spark, sf_dir):
    """T3 (batch): moving average of event values per user in (ts, event_id) order, mu = 0.9."""
    e = FX.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    r = T.ema_final(e, ["user_id"], ["ts", "event_id"], "value", MU)
    return r.select("user_id", F.round("ema", 6).alias("ema"), "n")


_TRACE_SQL = f"""
tr AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id,
              CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS step,
              (value - 100) / 50 AS q_halt, ({X.h(SEED, "'qc'", 'event_id')} % 400) / 100 - 2.0 AS q_continue
       FROM events)"""
_EXPLORE_SQL = (f"({X.h(SEED, "'explore'", 'user_id', 'day')} % 10 = 0)",
                f"(2 + {X.h(SEED, "'min_steps'", 'user_id', 'day')} % {MAX_STEPS - 1})")


@register("halt_step", f"""WITH {_TRACE_SQL}
SELECT user_id, day,
       min(CASE WHEN step >= {MAX_STEPS} OR q_halt > 0 THEN step END) AS halt_positive,
       min(CASE WHEN step >= {MAX_STEPS} OR q_halt > q_continue THEN step END) AS halt_compare,
       min(CASE WHEN step >= {MAX_STEPS} OR (q_halt > 0 AND (NOT {_EXPLORE_SQL[0]} OR step >= {_EXPLORE_SQL[1]})) THEN step END) AS halt_explore
FROM tr GROUP BY user_id, day""")
def halt_step(spark, sf_dir):
    """F10 + T4: halting step per (user, day) trace under both rules and with exploration (p = 0.1)."""
    tr = FX.step_trace(spark, sf_dir)
    explore = h(SEED, "explore", F.col("user_id"), F.col("day")) % 10 == 0
    min_steps = 2 + h(SEED, "min_steps", F.col("user_id"), F.col("day")) % (MAX_STEPS - 1)
    return tr.groupBy("user_id", "day").agg(  # one aggregation for the three rules
        T.halt_step(MAX_STEPS, "positive").alias("halt_positive"), T.halt_step(MAX_STEPS, "compare").alias("halt_compare"),
        T.halt_step(MAX_STEPS, "positive", explore, min_steps).alias("halt_explore"))


@register("continue_target", f"""WITH {_TRACE_SQL}
SELECT a.user_id, a.day, a.step,
       round(1.0 / (1.0 + exp(-(CASE WHEN a.step >= {MAX_STEPS} THEN b.q_halt ELSE greatest(b.q_halt, b.q_continue) END))), 6)
         AS target_q_continue
FROM tr a LEFT JOIN tr b ON b.user_id = a.user_id AND b.day = a.day AND b.step = a.step + 1""")
def continue_target(spark, sf_dir):
    """T5: bootstrapped continue target from the next step of the same trace."""
    tr = FX.step_trace(spark, sf_dir)
    t = T.continue_target(tr, ["user_id", "day"], MAX_STEPS)
    return t.select("user_id", "day", "step", F.round("target_q_continue", 6).alias("target_q_continue"))
