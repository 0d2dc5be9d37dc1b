"""Prediction with a caller-supplied model, Arrow-batched per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: rows of a model's batch: an Arrow batch may hold 10,000 token images, and every core has a worker of its own
MODEL_ROWS = 512


def predict(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``fn`` on batches of at most ``MODEL_ROWS`` rows of each partition (mapInPandas)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), MODEL_ROWS):
                yield fn(pdf.iloc[first:first + MODEL_ROWS].reset_index(drop=True))
    return df.mapInPandas(run, schema)


class Model:
    """A model that thinks in steps. One is made for each task, where it may load its weights."""

    def begin(self, batch: pd.DataFrame) -> pd.DataFrame:
        """The carry of each row before the first step, with the batch's index."""
        raise NotImplementedError

    def step(self, carry: pd.DataFrame, batch: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
        """(carry, outputs, halted) of rows that haven't halted."""
        raise NotImplementedError


def predict_until_halted(df: DataFrame, make: Callable[[], Model], keep: list[str], outputs: str, max_steps: int = 16) -> DataFrame:
    """Step every row until it halts, or ``max_steps``: the kept columns, the outputs of its last step, ``steps`` and ``halted``.

    Rows that have halted leave the batch, so a step costs what is still active;
    a batch ends when none is. An empty table gives no rows.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string(outputs).fields,
                           T.StructField("steps", T.IntegerType()), T.StructField("halted", T.BooleanType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            carry, active, step = model.begin(batch), batch, 0
            while len(active):
                step += 1
                carry, out, halted = model.step(carry, active)
                halted = np.asarray(halted, bool)
                done = halted | (step >= max_steps)
                if done.any():
                    yield pd.concat([active.loc[done, keep], out[done]], axis=1).assign(steps=step, halted=halted[done])[names]
                active, carry = active[~done], carry[~done]

    return df.mapInPandas(run, schema)


class RunningSum(Model):
    """The step-counting model the engine ships: adds one token a step and halts when the sum reaches a limit or the tokens end."""

    def __init__(self, limit: int, column: str = "inputs"):
        self.limit, self.column = limit, column

    def begin(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": 0, "total": 0}, index=batch.index)

    def step(self, carry: pd.DataFrame, batch: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
        size = batch[self.column].map(len).to_numpy(np.int64)
        flat = np.concatenate([*batch[self.column], [0]]).astype(np.int64)
        at = carry["at"].to_numpy()
        left = at < size
        total = carry["total"].to_numpy() + np.where(left, flat[np.minimum(np.cumsum(size) - size + at, len(flat) - 1)], 0)
        carry = pd.DataFrame({"at": at + 1, "total": total}, index=batch.index)
        out = pd.DataFrame({"total": total, "q_halt_logits": (total - self.limit).astype(float)}, index=batch.index)
        return carry, out, (total >= self.limit) | (at + 1 >= size)


def copy_input_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """The deterministic stand-in model the engine ships: predicts the input tokens,
    halts after one step with q = +1 when the input is not all padding."""
    size = pdf["inputs"].map(len).to_numpy(np.int64)
    seen = np.concatenate([[0], np.cumsum(np.concatenate([*pdf["inputs"], [0]]) > 1)])
    end = np.cumsum(size)
    q = np.where(seen[end] > seen[end - size], 1.0, -1.0)
    return pd.DataFrame({"puzzle_identifier": pdf["puzzle_identifier"], "inputs": pdf["inputs"],
                         "preds": pdf["inputs"], "q_halt_logits": q})
