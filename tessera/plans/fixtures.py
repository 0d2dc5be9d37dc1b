"""Adapters that shape the driver tables into the corpus shapes.

Every adapter is a DataFrame transformation over the given tables, so its
work grows with them. Keys and draws come from the seeded hash (R0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.functions.rng import h

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- F1 grids
GRID_WIDTHS = (8, 16, 4)


def embedding_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per vector: all its values quantised to 0..9, in rows of 4, 8 or 16 (a last row is filled up with 0).

    puzzle = vec_id div 4; example = (vec_id % 4) div 2; even = input, odd = output.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vid = F.col("vec_id")
    ww = F.element_at(F.array(*[F.lit(w) for w in GRID_WIDTHS]), (vid % len(GRID_WIDTHS) + 1).cast("int"))
    hh = F.ceil(F.size("embedding") / ww).cast("int")
    emb = F.col("embedding")
    grid = F.transform(F.sequence(F.lit(0), hh - 1), lambda r: F.transform(
        F.sequence(F.lit(0), ww - 1),
        lambda c: F.coalesce(F.least(F.lit(9), F.floor(F.abs(F.get(emb, r * ww + c).cast("double")) * 20)).cast("int"), F.lit(0))))
    return e.select(
        vid,
        F.floor(vid / 4).alias("puzzle_id"),
        F.floor((vid % 4) / 2).cast("int").alias("ex_idx"),
        (vid % 2).cast("int").alias("is_output"),
        grid.alias("grid"),
    )


def grid_puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as (puzzle_id, puzzle_name, ex_idx, role, input, output); ex 0 train, ex 1 test."""
    g = embedding_grids(spark, sf_dir)
    pairs = g.groupBy("puzzle_id", "ex_idx").agg(
        F.min_by("grid", "is_output").alias("input"),
        F.max_by("grid", "is_output").alias("output"),
        F.count("*").alias("n_grids"))
    # A vector without its partner (table size not a multiple of 4) is not an example.
    pairs = pairs.filter(F.col("n_grids") == 2).drop("n_grids")
    return pairs.select(
        "puzzle_id",
        F.concat(F.lit("p"), F.col("puzzle_id").cast("string")).alias("puzzle_name"),
        "ex_idx",
        F.when(F.col("ex_idx") == 0, F.lit("train")).otherwise(F.lit("test")).alias("role"),
        "input", "output")


# ------------------------------------------------- F2 predictions on grids
N_AUG = 8


def augmentation_plan(puzzles: DataFrame, n_aug: int = N_AUG, seed: int = SEED) -> DataFrame:
    """(puzzle_id, aug_idx, tid, perm, aug_name) for aug 0..n_aug-1; aug 0 is the identity."""
    keys = puzzles.select("puzzle_id", "puzzle_name").distinct()
    a = keys.withColumn("aug_idx", F.explode(F.sequence(F.lit(0), F.lit(n_aug - 1))))
    pid, aidx = F.col("puzzle_id"), F.col("aug_idx")
    tid = F.when(aidx == 0, F.lit(0)).otherwise(F.pmod(h(seed, "tid", pid, aidx), F.lit(8)).cast("int"))
    perm = F.when(aidx == 0, F.sequence(F.lit(0), F.lit(9))).otherwise(
        F.concat(F.array(F.lit(0)), F.transform(_perm9(seed, pid, aidx), lambda x: x + 1)))
    a = a.withColumn("tid", tid).withColumn("perm", perm)
    name = F.when(aidx == 0, F.col("puzzle_name")).otherwise(G.aug_name(F.col("puzzle_name"), F.col("tid"), F.col("perm")))
    return a.withColumn("aug_name", name).withColumn(
        "puzzle_identifier", (pid * n_aug + aidx + 1).cast("int"))


def _perm9(seed, pid, aidx):
    from tessera.functions.rng import random_perm
    return random_perm(9, seed, "perm", pid, aidx)


def grid_predictions(spark: SparkSession, sf_dir: str, n_aug: int = N_AUG, seed: int = SEED):
    """Predictions table (augmented, serialised space) plus identifiers and held-out puzzles.

    Per test pair and augmentation: with probability 0.6 the prediction is the
    true output, else the test output of puzzle 1 + hash % 3 further on (own
    output when that puzzle does not exist). One prediction in ten gets an end
    marker written at a hashed position, so cropping has real work to do. One
    puzzle in ten has no prediction at all, and one row in twenty has the blank
    identifier.
    """
    puz = grid_puzzles(spark, sf_dir)
    plan = augmentation_plan(puz, n_aug, seed)
    test = puz.filter(F.col("role") == "test")
    donor = test.select(F.col("puzzle_id").alias("donor_id"), F.col("output").alias("donor_out"))
    t = test.join(plan.drop("puzzle_name"), "puzzle_id")
    pid, aidx = F.col("puzzle_id"), F.col("aug_idx")
    t = t.filter(h(seed, "unanswered", pid) % 10 != 0).withColumn(
        "puzzle_identifier", F.when(h(seed, "blank", pid, aidx) % 20 == 0, F.lit(0)).otherwise(F.col("puzzle_identifier")))
    u = h(seed, "pred", pid, aidx)
    t = t.withColumn("u", u).withColumn(
        "donor_id", F.when(F.col("u") % 100 < 60, pid).otherwise(pid + 1 + F.col("u") % 3))
    t = t.join(donor, "donor_id", "left")
    pred = F.coalesce(F.col("donor_out"), F.col("output"))
    noise = h(seed, "noise", pid, aidx)
    t = t.select(
        F.lit("all").alias("set_name"),
        pid, aidx, "puzzle_identifier",
        G.serialise(G.augment(F.col("input"), F.col("tid"), F.col("perm"))).alias("inputs"),
        G.serialise(G.augment(F.col("output"), F.col("tid"), F.col("perm"))).alias("labels"),
        G.serialise(G.augment(pred, F.col("tid"), F.col("perm"))).alias("preds"),
        noise.alias("noise"),
        ((h(seed, "q", pid, aidx) % 2000) / 1000.0 - 1.0).alias("q_halt_logits"))
    corrupt = F.col("noise") % 10 == 0
    pos = F.pmod(F.col("noise"), F.lit(900)).cast("int")
    t = t.withColumn("preds", F.when(corrupt, F.transform(
        "preds", lambda x, i: F.when(i == pos, F.lit(1)).otherwise(x))).otherwise(F.col("preds"))).drop("noise")
    identifiers = plan.select("puzzle_identifier", F.col("aug_name").alias("puzzle_name"))
    return t, identifiers, puz


# --------------------------------------------------- F9 logits predictions
def logit_predictions(spark: SparkSession, sf_dir: str, seed: int = SEED) -> DataFrame:
    """One sequence per vector: 8 positions x 8 classes of logits from its 64 floats.

    label(pos) = hash(vec_id, pos) % 9 with 8 meaning ignored (-100); q_halt is
    the first float x 10; set = set_{label % 2}; one row in ten is not halted;
    step = vec_id div 64 (a training batch of 64 sequences).
    """
    from tessera.functions.util import let
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    emb, vid = F.col("embedding"), F.col("vec_id")
    logits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda c: emb[p * 8 + c].cast("double")))
    labels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: let(
        h(seed, "label", vid, p) % 9, lambda y: F.when(y == 8, F.lit(-100)).otherwise(y).cast("int")))
    return e.select(
        vid,
        F.concat(F.lit("set_"), (F.col("label") % 2).cast("string")).alias("set_name"),
        logits.alias("logits"), labels.alias("labels"),
        (emb[0].cast("double") * 10).alias("q_halt_logits"),
        (h(seed, "halt", vid) % 10 != 0).alias("halted"),
        (F.lit(1) + h(seed, "steps", vid) % 16).cast("int").alias("steps"),
        F.floor(vid / 64).alias("step"))


# ------------------------------------------------------------- F6 QA pairs
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User text at turn t -> question; assistant text at turn t+1 -> answer + '\\n#### ' + its length."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"),
        F.concat(F.col("text"), F.lit("\n#### "), F.length("text").cast("string")).alias("answer"))
    return u.join(a, ["conv_id", "turn"])


# ------------------------------------------------------- F5 logic puzzles
LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate"]


def logic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logic puzzle per order: header [House, Name, Part],
    rows [linenumber, 'S'+suppkey, partkey] in line order, size 'rows*3'."""
    shown = LINE_ORDER[1:4]  # the first of the order; lines that are equal in these make equal rows
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", *shown)
    g = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("_r"))

    def row(s):
        return F.array(s["l_linenumber"].cast("string"), F.concat(F.lit("S"), s["l_suppkey"].cast("string")), s["l_partkey"].cast("string"))

    return g.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"),
        F.concat(F.size("_r").cast("string"), F.lit("*3")).alias("size"),
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("puzzle"),
        F.array(F.lit("House"), F.lit("Name"), F.lit("Part")).alias("header"),
        F.transform("_r", row).alias("rows"))


# ------------------------------------------------------------ F3 sudoku
def sudoku_rows(spark: SparkSession, sf_dir: str, seed: int = SEED) -> DataFrame:
    """One board per order, in the CSV shape (source, q, a, rating).

    Solution cell (r, c) = (3*(r%3) + r div 3 + c) % 9 + 1, relabelled by a
    seeded digit permutation; a cell is blanked ('.') when its hash is even.
    """
    from tessera.functions.rng import random_perm
    from tessera.functions.util import let
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    relabel = random_perm(9, seed, "relabel", key)
    # base solution cell values 1..9 from the rule above, as one literal array
    base = F.array(*[F.lit((3 * ((i // 9) % 3) + i // 27 + i % 9) % 9 + 1) for i in range(81)])
    sol = let(relabel, lambda p: F.transform(base, lambda v: F.element_at(p, v) + 1))
    from tessera.functions.rng import digest
    # blank mask: cell i is blank when hex digit i of three digests is even
    mask = F.concat(digest(seed, "blank", key, 0), digest(seed, "blank", key, 1), digest(seed, "blank", key, 2))
    bits = F.split(F.translate(mask, "02468ace13579bdf", "1111111100000000"), "")
    o = o.select(key, sol.alias("_a"), bits.alias("_m"))
    q = F.zip_with("_a", F.slice("_m", 1, 81), lambda x, m: F.when(m == "1", F.lit(".")).otherwise(x.cast("string")))
    return o.select(F.concat(F.lit("o"), key.cast("string")).alias("source"),
                    F.array_join(q, "").alias("q"),
                    F.array_join(F.col("_a"), "").alias("a"),
                    (key % 10).cast("int").alias("rating"))


# -------------------------------------------------------------- F4 mazes
MAZE_CHARSET = "# SGo"  # fixed value: maze characters, ids 1..5 in this order


def maze_rows(spark: SparkSession, sf_dir: str, seed: int = SEED, side: int = 10) -> DataFrame:
    """One side x side character board per page, from characters all over its url and html
    (shape fixture, not a solvable maze)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", F.lit(""), "url", "html").alias("_t"))
    p = p.withColumn("_n", F.char_length("_t"))
    pid = F.col("page_id")
    n = side * side
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(
        F.lit(MAZE_CHARSET), ((F.ascii(F.substring(F.col("_t"), (F.floor(i * F.col("_n") / n) + 1).cast("int"), F.lit(1))) + i) % 5 + 1).cast("int"), F.lit(1)))
    sol = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.when(
        (F.element_at(F.col("_q"), i + 1) == " ") & (h(seed, "path", pid, i) % 3 == 0), F.lit("o"))
        .otherwise(F.element_at(F.col("_q"), i + 1)))
    p = p.select(pid, cells.alias("_q"))
    return p.select(F.concat(F.lit("p"), pid.cast("string")).alias("source"), F.array_join("_q", "").alias("q"),
                    F.array_join(sol, "").alias("a"), F.lit(0).alias("rating"))


# --------------------------------------------------------- F10 step trace
def step_trace(spark: SparkSession, sf_dir: str, seed: int = SEED) -> DataFrame:
    """seq = (user_id, day); step = 1-based position by (ts, event_id);
    q_halt = (value - 100) / 50; q_continue = (hash % 400) / 100 - 2."""
    from tessera.operators.trace import rank_within
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    e = e.withColumn("day", F.to_date("ts"))
    r = rank_within(e, ["user_id", "day"], ["ts", "event_id"])
    return r.select("user_id", "day", "event_id", (F.col("rank") + 1).cast("int").alias("step"),
                    ((F.col("value") - 100) / 50).alias("q_halt"),
                    ((h(seed, "qc", F.col("event_id")) % 400) / 100.0 - 2.0).alias("q_continue"))


# ------------------------------------------------------ F11 sparse deltas
def embedding_deltas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(table, deltas): table = embeddings as doubles; delta id = event_id modulo the
    number of vectors, grad = the vector of user_id modulo that, negated for 'error' events."""
    t = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    n = t.count() or 1
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    src = t.select(F.col("id").alias("src"), F.col("embedding").alias("vec"))
    d = ev.join(src, (ev.user_id % n) == src.src)
    sign = F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.lit(1.0))
    deltas = d.select((F.col("event_id") % n).alias("id"), F.transform("vec", lambda x: x * sign).alias("grad"))
    return t, deltas
