"""Steps whose tasks once held more than their share of the input."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import embed as N


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deltas_are_summed_by_blocks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), [rnd.choice([None, rnd.uniform(-1, 1)]) for _ in range(rnd.choice([0, 1, 15, 16, 17, 40]))]) for _ in range(300)]
    rows += [(4, None), (5, []), (6, [None, None]), (7, [1.0])]
    want = {}
    for i, grad in rows:
        for p, g in enumerate(grad or []):
            own = want.setdefault(i, {})
            own[p] = own.get(p) if g is None else (own.get(p) or 0.0) + g
    deltas = spark.createDataFrame(rows, "id long, grad array<double>").repartition(5)
    out = N.aggregate_deltas(deltas, round_to=6)
    got = {r["id"]: r["grad"] for r in out.collect()}
    assert got.keys() == want.keys()
    for i, own in want.items():
        assert got[i] == pytest.approx([None if own[p] is None else round(own[p], 6) for p in range(len(own))], abs=2e-6)
    assert "posexplode" not in plan_of(out)  # a number each would be an entry of the task's table


def grid_examples(spark, n=12):
    rnd = random.Random(5)
    def grid():
        return [[rnd.randrange(10) for _ in range(4)] for _ in range(3)]
    rows = [(p, f"p{p}", role, "train" if role == "train" or p % 2 == 0 else "test", k, grid(), grid()) for p in range(n) for k, role in enumerate(["train", "test"])]
    return spark.createDataFrame(rows, "puzzle_id long, puzzle_name string, role string, split string, ex_idx int, input array<array<int>>, output array<array<int>>")


def test_images_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(C, "ROWS_A_TASK", 4, raising=False)
    examples = grid_examples(spark)
    rows, identifiers = C.token_rows(examples, 3, 42)
    n = rows.count()
    assert rows.rdd.getNumPartitions() >= n / 4 > 8
    C.build_corpus(examples, str(tmp_path / "corpus"), 3, 42)
    loaded = C.load_corpus(spark, str(tmp_path / "corpus"))
    assert "ShuffledHashJoin" in plan_of(loaded) and "SortMergeJoin" not in plan_of(loaded)
    assert loaded.count() == n
    pick = ["split", "puzzle_id", "ex_idx", "puzzle_identifier", F.md5(F.array_join("inputs", ",")).alias("i"), F.md5(F.array_join("labels", ",")).alias("l")]
    assert sorted(map(tuple, loaded.select(*pick).collect())) == sorted(map(tuple, rows.select(*pick).collect()))
    names = {r["puzzle_identifier"]: r["puzzle_name"] for r in identifiers.collect()}
    assert all(names[r["puzzle_identifier"]] == r["puzzle_id"] for r in rows.select("puzzle_identifier", "puzzle_id").distinct().collect())
