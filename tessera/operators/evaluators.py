"""Evaluators with mergeable state, run over several data paths in one pass.

An evaluator begins with an empty state, updates it by batches, merges states
and makes metrics of the last one. Every task updates one state for each
evaluator and data path; only states are shuffled, and they are merged in two
levels, so that no task merges more than the square root of all, about. States are of
bounded size (sums by set, counts by step); an evaluator that needs a table of
its own, like votes, stays a DataFrame operator (``metrics.run_evaluators``).
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import score_sequences

SLOTS = 64


class Evaluator:
    """Base: ``columns`` are what update reads; a state is a dict of numbers that merge by addition unless a subclass says otherwise."""

    name = ""
    columns: tuple[str, ...] = ()

    def begin(self) -> dict:
        return defaultdict(float)

    def update(self, state: dict, batch: pd.DataFrame) -> None:
        raise NotImplementedError

    def merge(self, state: dict, other: dict) -> None:
        for k, v in other.items():
            state[k] += v

    def result(self, state: dict) -> Iterator[tuple[str, float | None]]:
        raise NotImplementedError


class SetMetrics(Evaluator):
    """Sums by set over scored sequences, each divided by the count of valid ones."""

    name = "metrics"
    columns = ("set_name", "valid", "accuracy", "exact", "q_halt_ok", "lm_loss", "q_halt_loss")

    def update(self, state: dict, batch: pd.DataFrame) -> None:
        valid = batch["valid"].to_numpy(bool)
        values = {"count": valid, "accuracy": np.where(valid, batch["accuracy"], 0), "exact_accuracy": valid & batch["exact"].to_numpy(bool),
                  "q_halt_accuracy": valid & batch["q_halt_ok"].to_numpy(bool), "lm_loss": batch["lm_loss"], "q_halt_loss": batch["q_halt_loss"]}
        for name, sums in pd.DataFrame(values).astype(float).groupby(batch["set_name"].to_numpy()).sum().iterrows():
            for metric, v in sums.items():
                state[name, metric] += v

    def result(self, state: dict) -> Iterator[tuple[str, float | None]]:
        for name, metric in sorted(state):
            if metric != "count":
                n = state[name, "count"]
                yield f"{name}/{metric}", state[name, metric] / n if n else None


class StepCounts(Evaluator):
    """Mean, least and greatest number of steps of halted sequences, and the share that halted."""

    name = "steps"
    columns = ("steps", "halted")

    def begin(self) -> dict:
        return {"rows": 0, "halted": 0, "sum": 0, "min": float("inf"), "max": float("-inf")}

    def update(self, state: dict, batch: pd.DataFrame) -> None:
        steps = batch.loc[batch["halted"].to_numpy(bool), "steps"]
        self.merge(state, {"rows": len(batch), "halted": len(steps), "sum": int(steps.sum()), "min": steps.min() if len(steps) else float("inf"),
                           "max": steps.max() if len(steps) else float("-inf")})

    def merge(self, state: dict, other: dict) -> None:
        for k, v in other.items():
            state[k] = min(state[k], v) if k == "min" else max(state[k], v) if k == "max" else state[k] + v

    def result(self, state: dict) -> Iterator[tuple[str, float | None]]:
        n = state["halted"]
        yield "halted", n / state["rows"] if state["rows"] else None
        yield "steps/mean", state["sum"] / n if n else None
        yield "steps/min", float(state["min"]) if n else None
        yield "steps/max", float(state["max"]) if n else None


def evaluate(paths: dict[str, DataFrame], evaluators: list[Evaluator]) -> DataFrame:
    """(data_path, evaluator, metric, value) of every evaluator over every data path.

    A data path without rows gives no metrics. Columns are checked before anything runs.
    """
    by_name = {e.name: e for e in evaluators}
    needed = sorted({c for e in evaluators for c in e.columns})
    rows = None
    for path, df in paths.items():
        own = df
        if set(needed) - set(df.columns) and {"labels", "q_halt_logits", "halted"} <= set(df.columns):
            own = score_sequences(df)
        missing = set(needed) - set(own.columns)
        if missing:
            raise ValueError(f"data path {path} lacks columns {sorted(missing)}")
        own = own.select(F.lit(path).alias("data_path"), *needed)
        rows = own if rows is None else rows.unionByName(own)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        held = {}
        for batch in batches:
            for path, part in batch.groupby("data_path"):
                for e in by_name.values():
                    if (path, e.name) not in held:
                        held[path, e.name] = e.begin()
                    e.update(held[path, e.name], part)
        slot = TaskContext.get().partitionId() % SLOTS
        yield pd.DataFrame([(*k, slot, pickle.dumps(dict(s))) for k, s in held.items()], columns=["data_path", "evaluator", "slot", "state"])

    def merged(name: str, states) -> dict:
        e = by_name[name]
        total = e.begin()
        for s in states:
            e.merge(total, pickle.loads(s))
        return total

    def level(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], pickle.dumps(dict(merged(key[1], pdf["state"]))))], columns=["data_path", "evaluator", "state"])

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = by_name[key[1]].result(merged(key[1], pdf["state"]))
        return pd.DataFrame([(key[0], key[1], m, v) for m, v in found], columns=["data_path", "evaluator", "metric", "value"])

    states = rows.mapInPandas(partial, "data_path string, evaluator string, slot int, state binary")
    states = states.groupBy("data_path", "evaluator", "slot").applyInPandas(level, "data_path string, evaluator string, state binary")
    return states.groupBy("data_path", "evaluator").applyInPandas(last, "data_path string, evaluator string, metric string, value double")
