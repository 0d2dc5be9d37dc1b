"""Golden vectors (FIXTURES.md section 3), computed through the Spark operators."""

from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.functions import scoring as S
from tessera.functions import text as T

GRID = [[1, 2, 3], [4, 0, 9]]
GRID_T = "array<array<int>>"


def one(spark, col, data=GRID, dtype=GRID_T):
    df = spark.createDataFrame([(data,)], f"g {dtype}")
    return df.select(col.alias("v")).collect()[0]["v"]


def test_dihedral(spark):
    expect = {1: [[3, 9], [2, 0], [1, 4]], 2: [[9, 0, 4], [3, 2, 1]], 3: [[4, 1], [0, 2], [9, 3]],
              4: [[3, 2, 1], [9, 0, 4]], 5: [[4, 0, 9], [1, 2, 3]], 6: [[1, 4], [2, 0], [3, 9]],
              7: [[9, 3], [0, 2], [4, 1]], 0: GRID}
    for t, e in expect.items():
        assert one(spark, G.dihedral(F.col("g"), t)) == e
        assert one(spark, G.dihedral(F.col("g"), F.lit(t))) == e
        assert one(spark, G.inverse_dihedral(G.dihedral(F.col("g"), F.lit(t)), F.lit(t))) == GRID


def test_perm_and_recolour(spark):
    perm = F.array(*[F.lit(int(c)) for c in "0312456789"])
    assert one(spark, G.inverse_perm(perm)) == [0, 2, 3, 1, 4, 5, 6, 7, 8, 9]
    assert one(spark, G.dihedral(G.recolour(F.col("g"), perm), 3)) == [[4, 3], [0, 1], [9, 2]]
    back = G.unaugment(G.augment(F.col("g"), F.lit(3), perm), F.lit(3), perm)
    assert one(spark, back) == GRID


def test_grid_hash(spark):
    assert one(spark, G.grid_hash(F.col("g"))) == "82ae0c82fc1dc5d06144b2d764ef54f67e77b5af00b6870cf38b34550ac818c2"
    assert one(spark, G.grid_hash(F.col("g")), [[0]]) == "9f44ac6acb8a37b00b615dc89259d306035be82dee7db2b472e4c48326195440"
    assert one(spark, G.grid_hash(F.col("g")), [[5, 5], [5, 5]]) == "4ee8a9b22461fc15ffa0cdee102533cb56e5734dce07c8ea5cabafc2ab904adc"
    assert one(spark, G.grid_hash(F.col("g")), []) == "96a296d224f285c67bee93c30f8a309157f0daa35dc5b87e410b78630a09cfc7"


def test_puzzle_hash(spark):
    from tessera.operators.augment import puzzle_hashes
    rows = [(1, GRID, [[0]]), (1, [[5, 5], [5, 5]], [[5, 5], [5, 5]])]
    for data in (rows, rows[::-1]):
        df = spark.createDataFrame(data, f"puzzle_id int, input {GRID_T}, output {GRID_T}")
        assert puzzle_hashes(df).collect()[0]["puzzle_hash"] == \
            "bb86dd8bdfbee66acedd573efa81325fbd92753546b2708a8a619ab4ea615247"


def test_serialise_and_crop(spark):
    seq = one(spark, G.serialise(F.col("g")), [[1, 2], [3, 4]])
    assert seq[:4] == [3, 4, 1, 0] and seq[30:34] == [5, 6, 1, 0] and seq[60:63] == [1, 1, 0]
    assert sum(seq) == 3 + 4 + 5 + 6 + 4
    full = [[7] * 30 for _ in range(30)]
    assert one(spark, G.crop(G.serialise(F.col("g"))), full) == full
    v = [0] * 900
    v[0:3] = [2, 3, 1]
    v[30:32] = [4, 1]
    assert one(spark, G.crop(F.col("g")), v, "array<int>") == [[0, 1]]
    assert one(spark, G.crop(F.col("g")), [0] * 900, "array<int>") == []


def test_losses(spark):
    logits = [[1.0, 0.0, -1.0]]
    got = []
    for y in range(3):
        df = spark.createDataFrame([(logits, [y])], "l array<array<double>>, y array<int>")
        got.append(df.select(S.stablemax_token_losses(F.col("l"), F.col("y"))[0]).collect()[0][0])
    assert [round(x, 6) for x in got] == [0.559616, 1.252763, 1.94591]
    df = spark.createDataFrame([(1.5,)], "q double")
    r = df.select(S.bce_with_logits(F.col("q"), F.lit(1.0)), S.sigmoid(F.col("q"))).collect()[0]
    assert round(r[0], 6) == 0.201413 and round(r[1], 6) == 0.817574


def test_accuracy(spark):
    df = spark.createDataFrame([([3, -100, 5], [3, 7, 4])], "l array<int>, p array<int>")
    r = df.select(S.token_accuracy(F.col("l"), F.col("p")), S.exact_match(F.col("l"), F.col("p"))).collect()[0]
    assert r[0] == 0.5 and r[1] is False


def test_final_answer(spark):
    df = spark.createDataFrame([("6*7=42\n#### 42 ",), ("no mark here ",)], "a string")
    assert [r[0] for r in df.select(T.final_answer(F.col("a"))).collect()] == ["42", "no mark here"]


def test_subsequences(spark):
    from tessera.operators.augment import expand_subsequences
    rows = [["1", "A", "p"], ["2", "B", "q"], ["3", "C", "r"]]
    df = spark.createDataFrame([("x", "3*4", "P", rows, ["House", "Name", "Part"])],
                               "id string, size string, puzzle string, rows array<array<string>>, header array<string>")
    out = expand_subsequences(df, "t").collect()
    assert [r["id"] for r in out] == ["x-1-0", "x-2-1", "x-3-2", "x-1-3", "x-2-4", "x-1-5"]
    assert [r["size"][-2:] for r in out] == ["*1", "*2", "*3", "*1", "*2", "*1"]
    assert out[1]["puzzle"].endswith("\n## Query\n['A' 'B']")
    assert [x[1] for x in out[4]["solution"]["rows"]] == ["B", "C"]


def test_split_sizes(spark):
    from tessera.operators.sampling import train_test_split
    for n, tr in ((10, 8), (9, 7)):
        df = spark.range(n)
        c = {r["split"]: r["count"] for r in train_test_split(df, 0.8, 42, "id").groupBy("split").count().collect()}
        assert c == {"train": tr, "test": n - tr}


def test_csr_and_interval(spark):
    from tessera.operators.ids import csr_offsets, lookup_interval
    df = spark.createDataFrame([(0,), (0,), (1,), (1,), (1,), (2,)], "p int")
    off = sorted((r["index"], r["start"], r["end"]) for r in csr_offsets(df, "p").collect())
    assert [o[1] for o in off] + [off[-1][2]] == [0, 2, 5, 6]
    pts = spark.createDataFrame([(x,) for x in (0, 1, 2, 4, 5)], "pos long")
    iv = csr_offsets(df, "p").select("index", "start", "end")
    got = sorted((r["pos"], r["index"]) for r in lookup_interval(pts, "pos", iv, bucket=2).collect())
    assert [g[1] for g in got] == [0, 0, 1, 1, 2]


def test_pack_greedy(spark):
    from tessera.operators.batching import pack_batches
    df = spark.createDataFrame(list(enumerate([3, 2, 4, 1, 5])), "order long, size long")
    got = sorted((r["order"], r["batch_id"], r["take"]) for r in pack_batches(df, 4).collect())
    assert got == [(0, 0, 3), (1, 0, 1), (2, 1, 4), (3, 2, 1), (4, 2, 3)]


def test_collate_pads(spark):
    from tessera.operators.batching import collate, eval_batches
    ex = spark.createDataFrame([(i, [i], [1], 7) for i in range(5)],
                               "k int, inputs array<int>, labels array<int>, puzzle_identifier int")
    b = eval_batches(ex, ["k"], 4, 2)
    c = collate(b, 4, 2, seq_len=1).filter("batch_id = 1")
    per = {(r["rank"], r["is_pad"]): r["count"] for r in c.groupBy("rank", "is_pad").count().collect()}
    assert per == {(0, False): 1, (0, True): 1, (1, True): 2}


def test_votes_pass_at_k(spark):
    from tessera.operators.votes import pass_at_k, submission
    votes = spark.createDataFrame([
        ("p1", "i1", "A", 3, 0.5, [[1]]), ("p1", "i1", "B", 3, 0.7, [[2]]), ("p1", "i1", "C", 1, 0.9, [[3]]),
        ("p2", "j1", "X", 1, 0.1, [[4]])],
        f"name string, input_hash string, pred_hash string, votes long, mean_q double, grid {GRID_T}")
    truth = spark.createDataFrame([("p1", 0, "i1", "A"), ("p1", 1, "i2", "Z"), ("p2", 0, "j1", "X")],
                                  "name string, ex_idx int, input_hash string, label_hash string")
    r = {x["k"]: x["pass_at_k"] for x in pass_at_k(votes, truth, ks=(1, 2)).collect()}
    assert r == {1: 0.5, 2: 0.75}
    s = sorted((x["name"], x["attempt"], x["pred_hash"]) for x in submission(votes, truth, 2).collect())
    assert s == [("p1", 1, "B"), ("p1", 2, "A"), ("p2", 1, "X"), ("p2", 2, "X")]


def test_ema_and_sign_sgd(spark):
    from tessera.operators.embed import aggregate_deltas, apply_sign_sgd
    from tessera.operators.trace import ema_final
    ev = spark.createDataFrame([(1, 0, 10.0), (1, 1, 20.0), (1, 2, 20.0)], "k int, t int, x double")
    assert round(ema_final(ev, ["k"], ["t"], "x", 0.9).collect()[0]["ema"], 6) == 11.9
    tab = spark.createDataFrame([(0, [1.0, -1.0]), (1, [5.0, 5.0])], "id int, embedding array<double>")
    d = spark.createDataFrame([(0, [1.5, 0.25]), (0, [0.5, -0.25])], "id int, grad array<double>")
    out = {r["id"]: r["embedding"] for r in apply_sign_sgd(tab, aggregate_deltas(d), 0.1, 0.5).collect()}
    assert [round(x, 6) for x in out[0]] == [0.85, -0.95] and out[1] == [5.0, 5.0]


def test_render_select_and_range(spark):
    from tessera.functions.text import render_solution
    from tessera.operators.expect import grid_cells_in_range
    from tessera.operators.metrics import select_outputs
    df = spark.createDataFrame([((["H"], [["1"]]),), ((["H"], []),)],
                               "s struct<header:array<string>,rows:array<array<string>>>")
    assert [r[0] for r in df.select(render_solution(F.col("s"))).collect()] == ['{"header":["H"],"rows":[["1"]]}', "<EMPTY>"]
    assert select_outputs(df.withColumn("x", F.lit(1)), ["x", "missing"]).columns == ["x"]
    g = spark.createDataFrame([([[1, 9]],), ([[1, 10]],)], "g array<array<int>>")
    assert [r[0] for r in g.select(grid_cells_in_range(F.col("g"))).collect()] == [True, False]
