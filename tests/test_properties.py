
import random

from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.functions.rng import colour_perm


def _grids(n, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        h, w = rnd.randint(1, 30), rnd.randint(1, 30)
        out.append((i, [[rnd.randint(0, 9) for _ in range(w)] for _ in range(h)]))
    return out


def test_augment_roundtrip_all_tids(spark):
    df = spark.createDataFrame(_grids(40), "i int, g array<array<int>>")
    df = df.withColumn("tid", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("perm", colour_perm(3, F.col("i")))
    back = G.unaugment(G.augment(F.col("g"), F.col("tid"), F.col("perm")), F.col("tid"), F.col("perm"))
    assert df.filter(F.to_json(back) != F.to_json("g")).count() == 0


def test_crop_inverts_serialise(spark):
    df = spark.createDataFrame(_grids(60, 11), "i int, g array<array<int>>")
    assert df.filter(F.to_json(G.crop(G.serialise(F.col("g")))) != F.to_json("g")).count() == 0


def test_sudoku_shuffle_keeps_validity(spark, sf_dir):
    from tessera.operators import boards as BD
    from tessera.plans import fixtures as FX
    s = BD.parse_sudoku(FX.sudoku_rows(spark, sf_dir)).withColumn("k", F.monotonically_increasing_id())
    sh = s.select(BD.sudoku_shuffle(F.col("a_cells"), 5, F.col("k"), F.lit(1)).alias("a"))
    rows = [r["a"] for r in sh.limit(50).collect()]
    for a in rows:
        grid = [a[r * 9:(r + 1) * 9] for r in range(9)]
        assert all(sorted(row) == list(range(1, 10)) for row in grid)
        assert all(sorted(grid[r][c] for r in range(9)) == list(range(1, 10)) for c in range(9))
        for br in range(3):
            for bc in range(3):
                box = [grid[br * 3 + i][bc * 3 + j] for i in range(3) for j in range(3)]
                assert sorted(box) == list(range(1, 10))


def test_dense_ids_and_partition_invariance(spark, sf_dir):
    from tessera.operators.ids import dense_id
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate"]
    a = dense_id(l, order, name="rid", num_partitions=3)
    b = dense_id(l.repartition(7), order, name="rid", num_partitions=5)
    n = l.count()
    ids = sorted(r["rid"] for r in a.select("rid").collect())
    assert ids == list(range(n))
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_packing_never_overfills(spark):
    from tessera.operators.batching import pack_batches
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, rnd.randint(1, 9)) for i in range(200)], "order long, size long")
    p = pack_batches(df, 16)
    per = p.groupBy("batch_id").agg(F.sum("take").alias("n")).collect()
    assert per and all(r["n"] == 16 for r in per)


def test_augment_shortage_for_one_colour(spark):
    from tessera.operators.augment import augment_puzzles
    df = spark.createDataFrame([(1, [[0, 0], [0, 0]], [[0, 0], [0, 0]])],
                               "puzzle_id int, input array<array<int>>, output array<array<int>>")
    group, short = augment_puzzles(df, 4, 42)
    assert group.count() == 1 and short.collect()[0]["n_aug"] == 0


def test_sudoku_vectorised_equals_columns(spark, sf_dir):
    from tessera.functions.rng import h
    from tessera.operators import boards as BD
    from tessera.plans import fixtures as FX
    s = BD.parse_sudoku(FX.sudoku_rows(spark, sf_dir)).withColumn("k", F.substring("source", 2, 20).cast("long")) \
        .withColumn("is_train", h(1, F.col("k")) % 2 == 0)
    a = BD.augment_sudoku(s, 3, 9, "k").select("k", "aug_idx", "q_cells", "a_cells")
    b = BD.augment_sudoku_vectorised(s, 3, 9, "k").select("k", "aug_idx", "q_cells", "a_cells")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_packing_blocks_agree(spark):
    from tessera.operators.batching import pack_batches
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, rnd.randint(1, 12)) for i in range(300)], "order long, size long")
    one = pack_batches(df, 16)
    for blk in (7, 50):
        many = pack_batches(df, 16, block=blk)
        assert many.count() == one.count() and one.exceptAll(many).count() == 0


def test_vectorised_shuffles_leave_originals(spark):
    from tessera.operators import boards as BD
    cells = [(i * 3 + i // 9) % 9 + 1 for i in range(81)]
    rows = [(1, cells, cells, True, "x"), (2, None, cells, False, "y"), (3, cells, None, None, None)]
    s = spark.createDataFrame(rows, "k int, q_cells array<int>, a_cells array<int>, is_train boolean, note string")
    got = BD.augment_sudoku_vectorised(s, 2, 9, "k")
    assert got.columns == [*s.columns, "aug_idx"]
    kept = {r.k: r for r in got.filter("aug_idx = 0").collect()}
    assert {k: (r.q_cells, r.a_cells, r.note) for k, r in kept.items()} == {1: (cells, cells, "x"), 2: (None, cells, "y"), 3: (cells, None, None)}
    assert [r.k for r in got.filter("aug_idx > 0").collect()] == [1, 1]
    assert BD.augment_sudoku_vectorised(s.limit(0), 2, 9, "k").count() == 0
    assert BD.augment_sudoku_vectorised(s.filter("k = 2"), 2, 9, "k").count() == 1
