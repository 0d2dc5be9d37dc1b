"""Reduce per-sequence scores to per-set / per-step metrics.

Per-sequence scores are Column expressions (functions.scoring); the reductions
are plain grouped sums with partial aggregation, which is what the reference's
all-reduce of per-rank sums does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring as S

METRICS = ("accuracy", "exact_accuracy", "q_halt_accuracy", "steps", "lm_loss", "q_halt_loss")


def score_sequences(preds: DataFrame, loss: str = "stablemax_cross_entropy",
                    include_padding: bool = False) -> DataFrame:
    """Per-sequence scores: (..., count, valid, accuracy, exact, q_halt_ok, lm_loss, q_halt_loss).

    ``preds`` needs labels, q_halt_logits, halted, steps and either logits or preds.
    ``include_padding`` mirrors the reference's halt loss over padding rows.
    """
    has_logits = "logits" in preds.columns
    p = preds
    if "preds" not in p.columns:
        p = p.withColumn("preds", S.argmax(F.col("logits")))
    labels, pr = F.col("labels"), F.col("preds")
    p = p.withColumn("count", S.valid_count(labels)) \
         .withColumn("exact", S.exact_match(labels, pr)) \
         .withColumn("valid", F.col("halted") & (F.col("count") > 0)) \
         .withColumn("accuracy", S.token_accuracy(labels, pr))
    p = p.withColumn("q_halt_ok", S.halt_correct(F.col("q_halt_logits"), F.col("exact")))
    if has_logits:
        p = p.withColumn("lm_loss", S.sequence_loss(S.loss_by_name(loss)(F.col("logits"), labels), labels))
    else:
        p = p.withColumn("lm_loss", F.lit(None).cast("double"))
    bce = S.bce_with_logits(F.col("q_halt_logits"), F.col("exact").cast("double"))
    if not include_padding:
        bce = F.when(F.col("count") > 0, bce).otherwise(F.lit(0.0))
    p = p.withColumn("q_halt_loss", bce)
    if "q_continue_logits" in p.columns and "target_q_continue" in p.columns:
        p = p.withColumn("q_continue_loss", S.bce_with_logits(F.col("q_continue_logits"), F.col("target_q_continue")))
    return p


def with_total_loss(scored: DataFrame) -> DataFrame:
    """M9: ``total_loss`` = lm + half of halt and, where the model has it, continue loss."""
    more = F.col("q_continue_loss") if "q_continue_loss" in scored.columns else F.lit(0.0)
    return scored.withColumn("total_loss", F.col("lm_loss") + 0.5 * (F.col("q_halt_loss") + more))


def _sums(valid: F.Column):
    def on(c):
        return F.sum(F.when(valid, c).otherwise(F.lit(0)))
    return [
        F.sum(valid.cast("long")).alias("count"),
        on(F.col("accuracy")).alias("accuracy"),
        on(F.col("exact").cast("long")).alias("exact_accuracy"),
        on(F.col("q_halt_ok").cast("long")).alias("q_halt_accuracy"),
        on(F.col("steps")).alias("steps"),
        F.sum("lm_loss").alias("lm_loss"),
        F.sum("q_halt_loss").alias("q_halt_loss"),
    ]


def metrics_by_set(scored: DataFrame, set_col: str = "set_name") -> DataFrame:
    """Sums per set, every metric divided by count (null when count is 0)."""
    s = scored.groupBy(set_col).agg(*_sums(F.col("valid")))
    return s.select(set_col, "count", *[F.try_divide(F.col(m).cast("double"), F.col("count")).alias(m) for m in METRICS])


def metrics_by_step(scored: DataFrame, global_batch: int, step_col: str = "step") -> DataFrame:
    """Per step, losses / global batch, other metrics / max(count, 1)."""
    s = scored.groupBy(step_col).agg(*_sums(F.col("valid")))
    div = F.greatest(F.col("count"), F.lit(1))
    out = [step_col, "count"]
    for m in METRICS:
        d = F.lit(float(global_batch)) if m.endswith("loss") else div
        out.append((F.col(m).cast("double") / d).alias(m))
    return s.select(*out)


def long_format(wide: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """(keys..., metric, value) rows from a wide metrics table (for K7 logs)."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metrics]))
    return wide.select(*keys, stack.alias("_m")).select(*keys, "_m.metric", "_m.value")


# ------------------------------------------------------------ U2 evaluators
EVALUATORS: dict[str, tuple[set[str], Callable[..., DataFrame]]] = {}


def register_evaluator(name: str, required: set[str]):
    """An evaluator is fn(predictions, **ctx) -> DataFrame(metric, value)."""
    def deco(fn):
        EVALUATORS[name] = (set(required), fn)
        return fn
    return deco


def run_evaluators(predictions: DataFrame, names: list[str], **ctx) -> DataFrame:
    """Run evaluators (required columns checked before planning), union results."""
    out = None
    for name in names:
        required, fn = EVALUATORS[name]
        missing = required - set(predictions.columns)
        if missing:
            raise ValueError(f"evaluator {name} needs columns {sorted(missing)}")
        r = fn(predictions.select(*sorted(required)), **ctx).select(
            F.lit(name).alias("evaluator"), "metric", F.col("value").cast("double"))
        out = r if out is None else out.unionByName(r)
    return out


@register_evaluator("metrics", {"set_name", "labels", "logits", "q_halt_logits", "halted", "steps"})
def _metrics_evaluator(predictions: DataFrame, **_):
    wide = metrics_by_set(score_sequences(predictions))
    lf = long_format(wide, ["set_name"])
    return lf.select(F.concat_ws("/", "set_name", "metric").alias("metric"), "value")


@register_evaluator("votes", {"puzzle_identifier", "inputs", "preds", "q_halt_logits"})
def _vote_evaluator(predictions: DataFrame, identifiers: DataFrame = None, puzzles: DataFrame = None, **_):
    from tessera.operators import votes as V
    decoded = V.decode_predictions(predictions, identifiers, with_grid=False)
    r = V.pass_at_k(V.vote_table(decoded, with_grid=False), V.truth_table(puzzles))
    return r.select(F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("metric"), F.col("pass_at_k").alias("value"))


def select_outputs(outputs: DataFrame, return_keys: list[str]) -> DataFrame:
    """Keep only the requested output columns that exist (Catalyst prunes the rest
    back to the scan)."""
    return outputs.select(*[k for k in return_keys if k in outputs.columns])
