"""Prediction in steps, evaluators with mergeable state, total loss."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluators as EV
from tessera.operators import extend as U
from tessera.operators import metrics as M


def test_rows_leave_the_batch_as_they_halt(spark):
    rows = [(1, [5, 5, 5]), (2, [30]), (3, [1, 1]), (4, []), (5, [1] * 40)]
    df = spark.createDataFrame(rows, "k int, inputs array<int>").coalesce(1)

    class Seen(U.RunningSum):
        def step(self, carry, batch):
            carry, out, halted = super().step(carry, batch)
            return carry, out.assign(active=len(batch)), halted

    got = {r.k: tuple(r)[1:] for r in U.predict_until_halted(df, lambda: Seen(12), ["k"], "total bigint, active int", 7).collect()}
    assert got == {1: (15, 2, 3, True), 2: (30, 5, 1, True), 3: (2, 3, 2, True), 4: (0, 5, 1, True), 5: (7, 1, 7, False)}
    assert U.predict_until_halted(df.limit(0), lambda: Seen(12), ["k"], "total bigint, active int").count() == 0


def test_copy_model(spark):
    import pandas as pd
    got = U.copy_input_model(pd.DataFrame({"puzzle_identifier": [1, 2, 3], "inputs": [[0, 1], [], [0, 5]]}))
    assert got["q_halt_logits"].tolist() == [-1.0, -1.0, 1.0] and got["preds"].tolist() == [[0, 1], [], [0, 5]]


def scored(spark, rows):
    return spark.createDataFrame(rows, "set_name string, valid boolean, accuracy double, exact boolean, q_halt_ok boolean, lm_loss double, q_halt_loss double, steps int, halted boolean")


def test_states_merge_the_same_however_rows_are_cut(spark):
    rows = [(f"s{k % 3}", k % 4 != 0, k / 50, k % 2 == 0, k % 5 == 0, float(k), k / 7, k % 9, k % 6 != 0) for k in range(50)] + [("none", False, 0., False, False, 1., 1., 3, False)]
    results = []
    for n in (1, 7, 130):
        df = scored(spark, rows).repartition(n)
        out = EV.evaluate({"a": df, "b": df.where("set_name = 's0'"), "empty": df.limit(0)}, [EV.SetMetrics(), EV.StepCounts()]).collect()
        results.append({(r.data_path, r.evaluator, r.metric): None if r.value is None else round(r.value, 9) for r in out})
    assert results[0] == results[1] == results[2]
    halted = [r[7] for r in rows if r[8]]
    assert results[0]["a", "steps", "steps/mean"] == round(sum(halted) / len(halted), 9)
    assert results[0]["a", "steps", "steps/max"] == max(halted) and results[0]["a", "metrics", "none/accuracy"] is None
    assert {k[0] for k in results[0]} == {"a", "b"}


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="lacks columns"):
        EV.evaluate({"a": scored(spark, []).drop("steps")}, [EV.StepCounts()])


def test_total_loss_with_and_without_continue(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "lm_loss double, q_halt_loss double")
    assert M.with_total_loss(df).first().total_loss == 2.0
    assert M.with_total_loss(df.withColumn("q_continue_loss", F.lit(4.0))).first().total_loss == 4.0
