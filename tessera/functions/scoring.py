"""Per-sequence scoring as Column expressions over predictions rows.

A row holds one sequence: ``labels array<int>``, ``logits array<array<double>>``
(positions x classes) or ``preds array<int>``, ``q_halt_logits double``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_LABEL_ID = -100   # fixed value: label positions excluded from scoring
STABLEMAX_EPS = 1e-30    # fixed value in the stablemax denominator


def sigmoid(x: Column) -> Column:
    """M10."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax(logits: Column) -> Column:
    """M1: index of the largest class per position, lowest index on ties."""
    return F.transform(logits, lambda l: (F.array_position(l, F.array_max(l)) - 1).cast("int"))


def valid_count(labels: Column) -> Column:
    """M2: positions whose label is not ignored."""
    return F.size(F.filter(labels, lambda x: x != IGNORE_LABEL_ID))


def divisor(labels: Column) -> Column:
    return F.greatest(valid_count(labels), F.lit(1))


def hits(labels: Column, preds: Column) -> Column:
    """Correct valid positions."""
    return F.aggregate(F.zip_with(labels, preds, lambda l, p: F.when((l != IGNORE_LABEL_ID) & (l == p), 1).otherwise(0)),
                       F.lit(0), lambda a, x: a + x)


def token_accuracy(labels: Column, preds: Column) -> Column:
    """M3: hits / max(count, 1)."""
    return hits(labels, preds).cast("double") / divisor(labels)


def exact_match(labels: Column, preds: Column) -> Column:
    """M4."""
    return hits(labels, preds) == valid_count(labels)


def halt_correct(q_halt: Column, exact: Column) -> Column:
    """M5: (q >= 0) agrees with exact match."""
    return (q_halt >= 0) == exact


def _stablemax_s(x: Column) -> Column:
    return F.when(x < 0, F.lit(1.0) / (F.lit(1.0) - x + STABLEMAX_EPS)).otherwise(x + 1.0)


def stablemax_token_losses(logits: Column, labels: Column) -> Column:
    """M7 per position: -log(s(x_label) / sum s(x)); 0 where the label is ignored."""
    def pos_loss(l, y):
        s = F.transform(l, _stablemax_s)
        total = F.aggregate(s, F.lit(0.0), lambda a, v: a + v)
        return F.when(y == IGNORE_LABEL_ID, F.lit(0.0)).otherwise(-F.log(F.element_at(s, y + 1) / total))
    return F.zip_with(logits, labels, pos_loss)


def softmax_token_losses(logits: Column, labels: Column) -> Column:
    """M8 per position: max-shifted log-sum-exp minus the label logit; 0 where ignored."""
    def pos_loss(l, y):
        m = F.array_max(l)
        lse = m + F.log(F.aggregate(l, F.lit(0.0), lambda a, v: a + F.exp(v - m)))
        return F.when(y == IGNORE_LABEL_ID, F.lit(0.0)).otherwise(lse - F.element_at(l, y + 1))
    return F.zip_with(logits, labels, pos_loss)


def sequence_loss(token_losses: Column, labels: Column) -> Column:
    """Sum of position losses over the valid-count divisor."""
    return F.aggregate(token_losses, F.lit(0.0), lambda a, v: a + v) / divisor(labels)


def bce_with_logits(x: Column, z: Column) -> Column:
    """M9: numerically stable binary cross-entropy with logits."""
    return F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x)))


LOSSES = {
    "stablemax_cross_entropy": stablemax_token_losses,
    "softmax_cross_entropy": softmax_token_losses,
}


def loss_by_name(name: str):
    """Pluggable loss by name."""
    try:
        return LOSSES[name]
    except KeyError:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(LOSSES)}") from None
