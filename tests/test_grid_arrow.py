"""The Arrow grid codec against the expressions of functions.grid, cell by cell."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.functions import grid_arrow as GA
from tessera.operators import extend as U


def made(seed, n=160):
    """Grids with symmetries, offsets and damaged tokens; a few nulls and the smallest and largest sizes."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        h, w = [(1, 1), (30, 30), (1, 30), (30, 1)][i] if i < 4 else (r.randint(1, 30), r.randint(1, 30))
        grid = None if i == 9 else [[r.randint(0, 9) for _ in range(w)] for _ in range(h)]
        marks = [(r.randrange(900), r.choice([0, 1, 13, -1])) for _ in range(r.choice([0, 0, 1, 3]))]
        if i % 16 == 7:
            marks.append((0, 1))  # nothing is left
        perm = [0, *r.sample(range(1, 10), 9)]
        rows.append((i, grid, i % 8, None if i == 11 else perm, r.randint(0, 30 - h), r.randint(0, 30 - w), marks))
    return rows


SCHEMA = "i int, g array<array<int>>, tid int, perm array<int>, pr int, pc int, marks array<struct<at: int, token: int>>"


@pytest.mark.parametrize("seed", range(3))
def test_codec_equals_expressions(spark, seed):
    d = spark.createDataFrame(made(seed), SCHEMA)
    expected = {r.i: r.image for r in d.filter("g is not null").select("i", G.serialise(F.col("g"), F.col("pr"), F.col("pc")).alias("image")).collect()}
    got = {r.i: r.image for r in GA.serialised(d, ["i"], {"image": "g"}, "pr", "pc").collect()}
    assert got == expected | {9: None}
    damaged = F.aggregate("marks", G.serialise(F.col("g")), lambda s, m: F.transform(s, lambda x, i: F.when(i == m["at"], m["token"]).otherwise(x)))
    d = d.select("i", "tid", "perm", F.when(F.col("g").isNotNull(), damaged).alias("seq"))
    grid = G.unaugment(G.crop(F.col("seq")), F.col("tid"), F.col("perm"))
    known = F.col("seq").isNotNull() & F.col("perm").isNotNull()
    expected = {r.i: (r.grid, r.hash) for r in d.filter(known).select("i", grid.alias("grid"), G.grid_hash(grid).alias("hash")).collect()}
    assert len(expected) == 158 and any(g == [] for g, _ in expected.values())
    expected |= {9: (None, None), 11: (None, None)}
    rows = GA.decoded(d.withColumn("again", F.col("seq")), ["i"], {"a": "seq", "b": "again"}, ("b",)).collect()
    assert {r.i: (r.b_grid, r.b_hash) for r in rows} == expected
    assert all(r.a_hash == r.b_hash for r in rows) and len(rows) == 160


def test_symmetries_are_undone(spark):
    d = spark.createDataFrame(made(7), SCHEMA).filter("g is not null and perm is not null")
    d = d.select("g", "tid", "perm", G.augment(F.col("g"), F.col("tid"), F.col("perm")).alias("a"), F.lit(0).alias("z"))
    out = GA.decoded(GA.serialised(d, ["g", "tid", "perm"], {"seq": "a"}, "z", "z"), ["g"], {"x": "seq"}, ("x",))
    assert out.filter((F.col("x_grid") != F.col("g")) | (F.col("x_hash") != G.grid_hash(F.col("g")))).count() == 0


def test_empty_and_wrong_input(spark):
    none = GA.serialised(spark.createDataFrame([], SCHEMA), ["tid", "perm"], {"s": "g"}, "pr", "pc")
    assert GA.decoded(none, [], {"x": "s"}, ("x",)).count() == 0
    short = spark.createDataFrame([([2, 2], 0, list(range(10)))], "s array<int>, tid int, perm array<int>")
    with pytest.raises(Exception, match="900 tokens"):
        GA.decoded(short, [], {"x": "s"}).collect()
    for grid, at in [([[1, 2], [3]], 0), ([[1] * 20], 15)]:
        with pytest.raises(Exception, match="rectangular"):
            GA.serialised(spark.createDataFrame([(grid, 0, at)], "g array<array<int>>, r int, c int"), [], {"x": "g"}, "r", "c").collect()


def test_large_batches_are_worked_on_in_pieces(spark):
    """A worker held the work arrays of 10,000 images at once."""
    batch = pa.RecordBatch.from_pydict({"i": list(range(1300))})
    parts = list(GA.pieces(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [512, 512, 276] and pa.Table.from_batches(parts)["i"].to_pylist() == batch["i"].to_pylist()
    rows = made(5, 1300)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).filter("g is not null and perm is not null")
    df = df.withColumn("x", G.serialise(G.augment(F.col("g"), F.col("tid"), F.col("perm"))))
    got = {r.i: r for r in GA.decoded(df, ["i"], {"a": "x"}, ("a",)).collect()}
    want = {r[0]: r[1] for r in rows if r[1] is not None and r[3] is not None}
    assert len(got) == len(want) > 1024 and all(got[i].a_grid == g for i, g in want.items())


def test_a_model_gets_small_batches(spark):
    df = spark.range(0, 2000, 1, 1).select(F.col("id").cast("int").alias("puzzle_identifier"), F.array(F.lit(0), F.col("id").cast("int")).alias("inputs"))

    def model(pdf):
        return U.copy_input_model(pdf).assign(n=len(pdf))

    out = U.predict(df, model, "puzzle_identifier int, inputs array<int>, preds array<int>, q_halt_logits double, n int")
    got = out.agg(F.count("*"), F.max("n"), F.sum(F.when(F.col("q_halt_logits") > 0, 1)), F.count_distinct("puzzle_identifier")).first()
    assert tuple(got) == (2000, U.MODEL_ROWS, 1998, 2000)
