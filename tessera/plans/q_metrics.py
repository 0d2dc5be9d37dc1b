"""Registered scoring queries (M1-M14, U2, U3) on the F9 logits fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import evaluators as EV
from tessera.operators import metrics as M
from tessera.plans import fixtures as FX
from tessera.plans import sqlexpr as X
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import SEED


def _stablemax(l, y):
    return X.let(f"list_transform({l}, lambda x: CASE WHEN x < 0 THEN 1.0 / (1.0 - x + 1e-30) ELSE x + 1.0 END)",
                 lambda s: f"-ln({s}[{y} + 1] / list_reduce({s}, lambda a, b: a + b))")


def _softmax(l, y):
    return X.let(f"list_max({l})", lambda m: (
        f"{m} + ln(list_reduce(list_transform({l}, lambda v: exp(v - {m})), lambda a, b: a + b)) - {l}[{y} + 1]"))


_LAB = X.h(SEED, "'label'", "vec_id", "p")
F9 = f"""
f AS (
  SELECT vec_id, 'set_' || CAST(label % 2 AS VARCHAR) AS set_name,
         list_transform(range(8), lambda p: list_transform(range(8), lambda c: CAST(embedding[p * 8 + c + 1] AS DOUBLE))) AS logits,
         list_transform(range(8), lambda p: CAST(CASE WHEN {_LAB} % 9 = 8 THEN -100 ELSE {_LAB} % 9 END AS INTEGER)) AS labels,
         CAST(embedding[1] AS DOUBLE) * 10 AS q_halt_logits,
         {X.h(SEED, "'halt'", 'vec_id')} % 10 <> 0 AS halted,
         CAST(1 + {X.h(SEED, "'steps'", 'vec_id')} % 16 AS INTEGER) AS steps,
         vec_id // 64 AS step
  FROM embeddings),
s0 AS (SELECT *, list_transform(logits, lambda l: CAST(list_position(l, list_max(l)) - 1 AS INTEGER)) AS preds FROM f),
s1 AS (
  SELECT *, CAST(len(list_filter(labels, lambda x: x <> -100)) AS INTEGER) AS count,
         list_reduce(list_transform(range(1, 9), lambda i: CASE WHEN labels[i] <> -100 AND labels[i] = preds[i] THEN 1 ELSE 0 END),
                     lambda a, b: a + b) AS hits,
         list_reduce(list_transform(range(1, 9), lambda i: CASE WHEN labels[i] = -100 THEN 0.0 ELSE {_stablemax('logits[i]', 'labels[i]')} END),
                     lambda a, b: a + b) AS sm_sum,
         list_reduce(list_transform(range(1, 9), lambda i: CASE WHEN labels[i] = -100 THEN 0.0 ELSE {_softmax('logits[i]', 'labels[i]')} END),
                     lambda a, b: a + b) AS sx_sum
  FROM s0),
scored AS (
  SELECT *, halted AND count > 0 AS valid, hits / greatest(count, 1) AS accuracy, hits = count AS exact,
         (q_halt_logits >= 0) = (hits = count) AS q_halt_ok,
         sm_sum / greatest(count, 1) AS lm_loss, sx_sum / greatest(count, 1) AS softmax_loss,
         CASE WHEN count > 0 THEN greatest(q_halt_logits, 0) - q_halt_logits * CAST(hits = count AS DOUBLE)
              + ln(1 + exp(-abs(q_halt_logits))) ELSE 0.0 END AS q_halt_loss
  FROM s1)"""

_SUMS = """count(*) FILTER (WHERE valid) AS count,
       sum(CASE WHEN valid THEN accuracy ELSE 0 END) AS accuracy,
       sum(CASE WHEN valid AND exact THEN 1 ELSE 0 END) AS exact_accuracy,
       sum(CASE WHEN valid AND q_halt_ok THEN 1 ELSE 0 END) AS q_halt_accuracy,
       sum(CASE WHEN valid THEN steps ELSE 0 END) AS steps,
       sum(lm_loss) AS lm_loss, sum(q_halt_loss) AS q_halt_loss"""


@register("seq_metrics", f"""WITH {F9}
SELECT vec_id, set_name, array_to_string(preds, ',') AS preds, count, round(accuracy, 6) AS accuracy, exact, q_halt_ok
FROM scored""")
def seq_metrics(spark, sf_dir):
    """M1-M5: argmax, valid count, token accuracy, exact match, halt correctness."""
    s = M.score_sequences(FX.logit_predictions(spark, sf_dir))
    return s.select("vec_id", "set_name", F.array_join("preds", ",").alias("preds"), "count",
                    F.round("accuracy", 6).alias("accuracy"), "exact", "q_halt_ok")


@register("stablemax_loss", f"""WITH {F9}
SELECT vec_id, round(lm_loss, 6) AS stablemax_loss, round(softmax_loss, 6) AS softmax_loss FROM scored""")
def stablemax_loss(spark, sf_dir):
    """M7 + M8 (U3: losses chosen by name)."""
    p = M.score_sequences(FX.logit_predictions(spark, sf_dir), loss="stablemax_cross_entropy")
    softmax = S.sequence_loss(S.loss_by_name("softmax_cross_entropy")(F.col("logits"), F.col("labels")), F.col("labels"))
    return p.select("vec_id", F.round("lm_loss", 6).alias("stablemax_loss"), F.round(softmax, 6).alias("softmax_loss"))


@register("halt_loss", f"""WITH {F9}
SELECT vec_id, round(q_halt_loss, 6) AS q_halt_loss, round(lm_loss + 0.5 * q_halt_loss, 6) AS total_loss,
       round(1.0 / (1.0 + exp(-q_halt_logits)), 6) AS q_halt_prob FROM scored""")
def halt_loss(spark, sf_dir):
    """M9 + M10: halt BCE, total = lm + 0.5 * (halt + continue), sigmoid of q."""
    from tessera.functions.scoring import sigmoid
    s = M.score_sequences(FX.logit_predictions(spark, sf_dir))
    return s.select("vec_id", F.round("q_halt_loss", 6).alias("q_halt_loss"),
                    F.round(F.col("lm_loss") + 0.5 * F.col("q_halt_loss"), 6).alias("total_loss"),
                    F.round(sigmoid(F.col("q_halt_logits")), 6).alias("q_halt_prob"))


_MCOLS = ["accuracy", "exact_accuracy", "q_halt_accuracy", "steps", "lm_loss", "q_halt_loss"]


@register("metrics_by_set", f"""WITH {F9}, agg AS (SELECT set_name, {_SUMS} FROM scored GROUP BY set_name)
SELECT set_name, count, {", ".join(f"round(CASE WHEN count = 0 THEN NULL ELSE {m} / count END, 6) AS {m}" for m in _MCOLS)}
FROM agg""")
def metrics_by_set(spark, sf_dir):
    """M6 + M11: per-set sums over scored rows, each divided by the count."""
    w = M.metrics_by_set(M.score_sequences(FX.logit_predictions(spark, sf_dir)))
    return w.select("set_name", "count", *[F.round(m, 6).alias(m) for m in _MCOLS])


@register("metrics_by_step", f"""WITH {F9}, agg AS (SELECT step, {_SUMS} FROM scored GROUP BY step)
SELECT step, count, {", ".join(
    f"round({m} / {'64.0' if m.endswith('loss') else 'greatest(count, 1)'}, 6) AS {m}" for m in _MCOLS)}
FROM agg""")
def metrics_by_step(spark, sf_dir):
    """Training-log reduction per step (losses over the global batch of 64)."""
    w = M.metrics_by_step(M.score_sequences(FX.logit_predictions(spark, sf_dir)), 64)
    return w.select("step", "count", *[F.round(m, 6).alias(m) for m in _MCOLS])


@register("evaluator_registry", f"""WITH {F9}, agg AS (SELECT set_name, {_SUMS} FROM scored GROUP BY set_name),
w AS (SELECT set_name, {", ".join(f"CASE WHEN count = 0 THEN NULL ELSE {m} / count END AS {m}" for m in _MCOLS)} FROM agg)
SELECT 'metrics' AS evaluator, set_name || '/' || metric AS metric, round(value, 6) AS value
FROM (UNPIVOT w ON {", ".join(_MCOLS)} INTO NAME metric VALUE value)""")
def evaluator_registry(spark, sf_dir):
    """M14 + U2: evaluators by name, required columns checked, results unioned as (evaluator, metric, value)."""
    r = M.run_evaluators(FX.logit_predictions(spark, sf_dir), ["metrics"])
    return r.select("evaluator", "metric", F.round("value", 6).alias("value"))


@register("continue_loss", f"""WITH {F9},
c AS (SELECT s.vec_id, step, valid, lm_loss, q_halt_loss, CAST(e.embedding[2] AS DOUBLE) * 10 AS x, greatest(0.0, least(1.0, CAST(e.embedding[3] AS DOUBLE) + 0.5)) AS z
  FROM scored s JOIN embeddings e ON e.vec_id = s.vec_id),
l AS (SELECT *, greatest(x, 0) - x * z + ln(1 + exp(-abs(x))) AS q_continue_loss FROM c)
SELECT step, count(*) FILTER (WHERE valid) AS count, round(sum(q_continue_loss) / 64.0, 6) AS q_continue_loss,
       round(sum(lm_loss + 0.5 * (q_halt_loss + q_continue_loss)) / 64.0, 6) AS total_loss FROM l GROUP BY step""")
def continue_loss(spark, sf_dir):
    """M9 + M12: continue loss against bootstrapped targets and the total loss, per training step of 64 sequences."""
    e = FX.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("_id"), (F.element_at("embedding", 2).cast("double") * 10).alias("q_continue_logits"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at("embedding", 3).cast("double") + 0.5)).alias("target_q_continue"))
    p = FX.logit_predictions(spark, sf_dir)
    scored = M.with_total_loss(M.score_sequences(p.join(e, p["vec_id"] == e["_id"])))
    return scored.groupBy("step").agg(F.sum(F.col("valid").cast("long")).alias("count"), *[
        F.round(F.sum(c) / 64.0, 6).alias(c) for c in ("q_continue_loss", "total_loss")])


_EVALS = ["accuracy", "exact_accuracy", "q_halt_accuracy", "lm_loss", "q_halt_loss"]


@register("evaluators_by_path", f"""WITH {F9}, p AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'held_out' ELSE 'seen' END AS data_path FROM scored),
agg AS (SELECT data_path, set_name, {_SUMS} FROM p GROUP BY data_path, set_name),
w AS (SELECT data_path, set_name, {", ".join(f"{m} / nullif(count, 0) AS {m}" for m in _EVALS)} FROM agg),
t AS (SELECT data_path, avg(CAST(halted AS INTEGER)) AS halted, avg(steps) FILTER (WHERE halted) AS "steps/mean",
      CAST(min(steps) FILTER (WHERE halted) AS DOUBLE) AS "steps/min", CAST(max(steps) FILTER (WHERE halted) AS DOUBLE) AS "steps/max" FROM p GROUP BY data_path)
SELECT data_path, 'metrics' AS evaluator, set_name || '/' || metric AS metric, round(value, 6) AS value
FROM (UNPIVOT w ON {", ".join(_EVALS)} INTO NAME metric VALUE value)
UNION ALL SELECT data_path, 'steps', metric, round(value, 6) FROM (UNPIVOT t ON halted, "steps/mean", "steps/min", "steps/max" INTO NAME metric VALUE value)""")
def evaluators_by_path(spark, sf_dir):
    """U2 + M14: two evaluators with mergeable state over two data paths."""
    p = FX.logit_predictions(spark, sf_dir)
    paths = {"held_out": p.where("vec_id % 3 = 0"), "seen": p.where("vec_id % 3 <> 0")}
    out = EV.evaluate(paths, [EV.SetMetrics(), EV.StepCounts()])
    return out.select("data_path", "evaluator", "metric", F.round("value", 6).alias("value"))


_LIMIT, _STEPS = 20, 6


@register("predict_until_halted", f"""WITH {F9},
i AS (SELECT vec_id, list_transform(labels, lambda x: greatest(x, 0) + 1) AS v FROM f),
r AS (SELECT vec_id, v, list_transform(range(1, len(v) + 1), lambda k: list_sum(v[1:k])) AS sums FROM i),
n AS (SELECT vec_id, sums, least({_STEPS}, coalesce(list_position(list_transform(sums, lambda x: x >= {_LIMIT}), true), len(v))) AS steps, len(v) AS size FROM r)
SELECT vec_id, CAST(steps AS INTEGER) AS steps, CAST(sums[steps] AS BIGINT) AS total, CAST(sums[steps] AS DOUBLE) - {_LIMIT} AS q_halt_logits,
       sums[steps] >= {_LIMIT} OR steps = size AS halted FROM n""")
def predict_until_halted(spark, sf_dir):
    """Every row is stepped until the model halts it, or six steps."""
    from tessera.operators import extend as U
    p = FX.logit_predictions(spark, sf_dir).select("vec_id", F.transform("labels", lambda x: F.greatest(x, F.lit(0)) + 1).alias("inputs"))
    out = U.predict_until_halted(p, lambda: U.RunningSum(_LIMIT), ["vec_id"], "total bigint, q_halt_logits double", _STEPS)
    return out.select("vec_id", "steps", "total", "q_halt_logits", "halted")
