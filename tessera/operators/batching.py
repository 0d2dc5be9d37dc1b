"""Epoch order, greedy packing into global batches, eval batches, ranks, collate.

Greedy packing with truncation (B2) is a sequential recurrence: a batch that
starts at order position s ends at the first p whose running size reaches the
batch size; the next batch starts at p + 1. It is computed exactly without a
single-task fold:
  1. prefix sums of puzzle sizes (distributed, ids.prefix_sum);
  2. next(s) for every s by a bucketed range join on the prefix sums;
  3. the chain of batch starts reachable from 0 by pointer doubling: each round
     squares the jump table and extends the reached set (log rounds, each a
     pair of joins, lineage cut by a reliable checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rng import h
from tessera.operators.ids import dense_id, lookup_interval, prefix_sum
from tessera.session import materialise

IGNORE_LABEL_ID = -100


def epoch_order(groups: DataFrame, group_col: str, epochs: int, seed: int, iteration: int = 1) -> DataFrame:
    """B1: ``epochs`` seeded permutations of the groups, concatenated; seed = seed + iteration.

    Returns (group, epoch, order) with order dense over the concatenation.
    """
    spark = groups.sparkSession
    g = groups.select(group_col).distinct()
    ep = spark.range(epochs).select(F.col("id").cast("int").alias("epoch"))
    e = g.crossJoin(F.broadcast(ep))  # epochs is a small parameter
    e = e.withColumn("_h", h(seed + iteration, F.col("epoch"), F.col(group_col)))
    return dense_id(e, ["epoch", "_h", group_col], name="order").drop("_h")


def pick_puzzles(order: DataFrame, puzzles: DataFrame, group_col: str, puzzle_col: str,
                 seed: int, iteration: int = 1) -> DataFrame:
    """R6 per order slot: one seeded puzzle of the slot's group -> (order, group, puzzle, size)."""
    j = order.join(puzzles.select(group_col, puzzle_col, "size"), group_col)
    key = F.struct(h(seed + iteration, "pick", F.col("order"), F.col(puzzle_col)).alias("k"), F.col(puzzle_col).alias("p"))
    return j.groupBy("order", group_col).agg(F.min_by(F.struct(puzzle_col, "size"), key).alias("_p")) \
            .select("order", group_col, F.col(f"_p.{puzzle_col}").alias(puzzle_col), F.col("_p.size").alias("size"))


def _chain_from_zero(nxt: DataFrame, max_steps: int) -> DataFrame:
    """Nodes reachable from 0 by repeated ``next`` (pointer doubling). nxt: (s, t).

    After round k the reached set holds next^i(0) for all i < 2^k; rounds stop
    once 2^k exceeds ``max_steps`` or the set stops growing.
    """
    # The jump table refers to itself twice per round, so it is cut with a
    # reliable checkpoint every round (its plan would double otherwise). The
    # reached set refers to its predecessor once (join, then both endpoints),
    # so its lineage grows by one join per round and a persist is enough.
    jump = materialise(nxt)
    reached = jump.sparkSession.createDataFrame([(0,)], "src long")
    span, size = 1, 1
    held = []
    while span <= max_steps:
        nxt_reached = reached.join(jump, "src").select(F.explode(F.array("src", "t")).alias("src")).distinct().persist()
        held.append(nxt_reached)
        new_size = nxt_reached.count()
        reached = nxt_reached
        if new_size == size:
            break
        size = new_size
        j2 = jump.alias("a").join(jump.alias("b"), F.col("a.t") == F.col("b.src")) \
            .select(F.col("a.src").alias("src"), F.col("b.t").alias("t"))
        jump = materialise(j2)
        span *= 2
    out = materialise(reached)
    for h_ in held:
        h_.unpersist()
    return out


def _block_exits(block_len: int, n_total: int):
    def fn(pdf):
        import numpy as np
        import pandas as pd
        pdf = pdf.sort_values("src")
        src, t = pdf["src"].to_numpy(), pdf["t"].to_numpy()
        end = (src[0] // block_len + 1) * block_len
        pos = {int(v): i for i, v in enumerate(src)}
        x = np.empty_like(t)
        for i in range(len(src) - 1, -1, -1):   # reverse scan: next(s) > s
            nt = int(t[i])
            x[i] = nt if (nt >= end or nt >= n_total or nt == src[i]) else x[pos[nt]]
        return pd.DataFrame({"src": src, "x": x})
    return fn


def _block_walk(block_len: int, n_total: int):
    def fn(pdf):
        import pandas as pd
        entry = pdf["entry"].iloc[0]
        pdf = pdf.sort_values("src")
        nxt = dict(zip(pdf["src"].tolist(), pdf["t"].tolist()))
        end = (int(pdf["src"].iloc[0]) // block_len + 1) * block_len
        out, s = [], int(entry)
        while s < end and s < n_total:
            out.append(s)
            s = int(nxt[s])
        return pd.DataFrame({"src": out}, dtype="int64")
    return fn


def _chain_by_blocks(nxt: DataFrame, n_total: int, block_len: int, max_span: int | None = None) -> DataFrame:
    """Chain of batch starts from 0, exactly, in bounded pieces.

    Positions are cut into range blocks of ``block_len`` (one pandas group each,
    bounded by construction). Per block, a reverse scan gives every node's
    exit: the first chain node at or after the next block. Pointer doubling over
    exits then finds each block's entry in log(#blocks) rounds, and a second
    per-block pass walks the chain from that entry.
    """
    spark = nxt.sparkSession
    body = nxt.filter(F.col("src") < n_total).withColumn("_blk", F.floor(F.col("src") / block_len))
    exits = body.groupBy("_blk").applyInPandas(_block_exits(block_len, n_total), "src long, x long")
    if max_span is not None and max_span < block_len:
        # a batch covers at most max_span positions, so a block is entered within
        # its first max_span positions: only those nodes take part in the doubling
        exits = exits.filter(F.pmod(F.col("src"), F.lit(block_len)) < max_span)
    exits = exits.unionByName(spark.createDataFrame([(n_total, n_total)], "src long, x long"))
    entries = _chain_from_zero(exits.withColumnRenamed("x", "t"), n_total // block_len + 2)
    entries = entries.filter(F.col("src") < n_total).withColumn("_blk", F.floor(F.col("src") / block_len))
    # one entry row per block: #blocks grows with the data, so no broadcast hint
    # (AQE turns it into a broadcast at run time when it is small)
    walk_in = body.join(entries.withColumnRenamed("src", "entry"), "_blk")
    return materialise(walk_in.groupBy("_blk").applyInPandas(_block_walk(block_len, n_total), "src long"))


def pack_batches(order_sizes: DataFrame, batch_size: int, drop_last: bool = True,
                 block: int | None = None) -> DataFrame:
    """B2 + B3: greedy packing with truncation.

    ``order_sizes``: (order, size) with dense order 0..N-1; puzzles of size 0
    take no slot and are in no batch.
    Returns (order, batch_id, take, slot_start): the puzzle at ``order`` gives
    ``take`` examples to batch ``batch_id`` at slots slot_start.. (the rest of
    an overflowing puzzle is discarded, as in the reference).
    """
    spark = order_sizes.sparkSession
    some = order_sizes.filter(F.col("size") >= 1).select("order", "size")
    if order_sizes.filter("size is null or size < 1").limit(1).count():
        # positions without the empty puzzles, and the orders they stand for
        dense = materialise(dense_id(some, ["order"], name="_dense"))
        packed = pack_batches(dense.select(F.col("_dense").alias("order"), "size"), batch_size, drop_last, block)
        return packed.withColumnRenamed("order", "_dense").join(dense.select("_dense", "order"), "_dense") \
            .select("order", "batch_id", "take", "slot_start")
    ps = prefix_sum(order_sizes.select("order", "size"), "size", ["order"], name="run_lo")
    ps = materialise(ps.withColumn("run_hi", F.col("run_lo") + F.col("size")))
    stats = ps.agg(F.count("*").alias("n"), F.max("run_hi").alias("total")).collect()[0]
    n_total, total = int(stats["n"]), int(stats["total"] or 0)
    if n_total == 0:
        return spark.createDataFrame([], "order long, batch_id long, take int, slot_start long")
    # next(s): first p with I(p) >= S(s) + B, i.e. S(p) <= S(s) + B - 1 < I(p)
    targets = ps.select(F.col("order").alias("src"), (F.col("run_lo") + batch_size - 1).alias("_tgt"))
    found = lookup_interval(targets, "_tgt", ps.select(F.col("order").alias("p"), F.col("run_lo"), F.col("run_hi")),
                            start_col="run_lo", end_col="run_hi", bucket=max(batch_size * 4, 1024))
    nxt = targets.join(found.select("src", "p"), "src", "left") \
        .select("src", F.coalesce(F.col("p") + 1, F.lit(n_total)).cast("long").alias("t"))
    nxt = nxt.unionByName(spark.createDataFrame([(n_total, n_total)], "src long, t long"))
    starts = _chain_by_blocks(nxt, n_total, block or max(batch_size * 128, 4096), max_span=batch_size) \
        .filter(F.col("src") < n_total)
    starts = dense_id(starts, ["src"], name="batch_id")
    bounds = starts.join(nxt, "src").join(ps.select(F.col("order").alias("src"), F.col("run_lo").alias("base_lo")), "src")
    # the last batch may be short: it is full only if the running size reaches B
    bounds = bounds.withColumn("end_sum", F.col("base_lo") + batch_size)
    members = lookup_interval(ps, "order", bounds.select("batch_id", F.col("src").alias("b_start"),
                                                          F.col("t").alias("b_end"), "base_lo", "end_sum"),
                              start_col="b_start", end_col="b_end", bucket=max(batch_size * 4, 1024))
    members = members.withColumn("take", F.least(F.col("size"), F.col("end_sum") - F.col("run_lo")).cast("int")) \
                     .withColumn("slot_start", F.col("run_lo") - F.col("base_lo"))
    out = members.select("order", "batch_id", "take", "slot_start", (F.col("run_hi") >= F.col("end_sum")).alias("_closes"))
    if drop_last:
        closed = out.groupBy("batch_id").agg(F.max("_closes").alias("_full"))
        out = out.join(closed.filter("_full"), "batch_id", "left_semi")
    return out.drop("_closes")


def batch_examples(packed: DataFrame, examples: DataFrame, puzzle_col: str, example_key: list[str],
                   batch_size: int, replicas: int, seed: int, iteration: int = 1, draw_key: list[str] | None = None) -> DataFrame:
    """R7 + B5: the examples of a packed plan.

    ``packed`` has (order, puzzle, batch_id, take, slot_start). ``take`` seeded
    examples of a slot's puzzle, without replacement, go to the slots from
    slot_start on; a slot's rank and place in it follow from its number. Adds
    (order, batch_id, slot, rank, local_slot) to the columns of ``examples``. The
    draw hashes ``draw_key``, ties going by ``example_key`` (by default the same).
    """
    if batch_size % replicas:
        raise ValueError("global batch must be divisible by replicas (V7)")
    local = batch_size // replicas
    j = packed.select("order", puzzle_col, "batch_id", "take", "slot_start").join(examples, puzzle_col)
    draw = h(seed + iteration, "example", F.col("order"), *[F.col(c) for c in draw_key or example_key])
    j = j.withColumn("_n", F.row_number().over(Window.partitionBy("order").orderBy(draw, *example_key)))
    slot = (F.col("slot_start") + F.col("_n") - 1).cast("int")
    return j.filter(F.col("_n") <= F.col("take")).withColumn("slot", slot) \
            .withColumn("rank", F.floor(F.col("slot") / local).cast("int")) \
            .withColumn("local_slot", (F.col("slot") % local).cast("int")).drop("_n", "take", "slot_start")


def train_batches(examples: DataFrame, sets: list[str], group_col: str, puzzle_col: str, example_key: list[str], epochs: int,
                  batch_size: int, replicas: int, seed: int, iteration: int = 1, set_col: str = "set_name",
                  draw_key: list[str] | None = None) -> DataFrame:
    """B1 -> R6 -> B2 -> R7 -> B5 for every set in turn: the training batches of one pass over ``sets``.

    Each set is shuffled and packed on its own, with the next iteration number;
    short last batches are dropped.
    """
    out = None
    for i, name in enumerate(sets):  # a few names, a parameter
        own = examples.filter(F.col(set_col) == name)
        puzzles = own.groupBy(group_col, puzzle_col).agg(F.count("*").alias("size"))
        order = epoch_order(puzzles, group_col, epochs, seed, iteration + i)
        plan = materialise(pick_puzzles(order, puzzles, group_col, puzzle_col, seed, iteration + i))
        packed = pack_batches(plan.select("order", "size"), batch_size).join(plan.select("order", puzzle_col), "order")
        rows = batch_examples(packed, own, puzzle_col, example_key, batch_size, replicas, seed, iteration + i, draw_key)
        out = rows if out is None else out.unionByName(rows)
    return out


def eval_batches(examples: DataFrame, order, batch_size: int, replicas: int = 1) -> DataFrame:
    """B4 + B5: sequential evaluation batches (short last batch kept) and rank slices.

    Adds (position, batch_id, slot, rank, local_slot).
    """
    if batch_size % replicas:
        raise ValueError("global batch must be divisible by replicas (V7)")
    local = batch_size // replicas
    d = dense_id(examples, order, name="position")
    return d.withColumn("batch_id", F.floor(F.col("position") / batch_size)) \
            .withColumn("slot", (F.col("position") % batch_size).cast("int")) \
            .withColumn("rank", F.floor(F.col("slot") / local).cast("int")) \
            .withColumn("local_slot", (F.col("slot") % local).cast("int"))


def collate(batched: DataFrame, batch_size: int, replicas: int, seq_len: int,
            pad_id: int = 0, blank_id: int = 0, ignore_label_id: int | None = 0) -> DataFrame:
    """Int casting, ignore label -> -100, and pad rows for each rank's short batch.

    ``batched`` has (batch_id, rank, local_slot, inputs, labels, puzzle_identifier).
    Pad rows get inputs = pad, labels = -100, identifier = blank.
    """
    local = batch_size // replicas
    labels = F.col("labels")
    if ignore_label_id is not None:
        labels = F.transform(labels, lambda x: F.when(x == ignore_label_id, F.lit(IGNORE_LABEL_ID)).otherwise(x))
    real = batched.select("batch_id", "rank", "local_slot",
                          F.transform("inputs", lambda x: x.cast("int")).alias("inputs"),
                          F.transform(labels, lambda x: x.cast("int")).alias("labels"),
                          F.col("puzzle_identifier").cast("int"), F.lit(False).alias("is_pad"))
    # every (batch, rank) of the plan, including ranks that got no real row
    batches = batched.select("batch_id").distinct() \
        .withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    counts = batched.groupBy("batch_id", "rank").agg(F.count("*").alias("n_real"))
    slots = batches.join(counts, ["batch_id", "rank"], "left").fillna(0, ["n_real"]) \
        .filter(F.col("n_real") < local) \
        .withColumn("local_slot", F.explode(F.sequence(F.col("n_real").cast("int"), F.lit(local - 1))))
    pads = slots.select("batch_id", "rank", "local_slot",
                        F.array_repeat(F.lit(pad_id), seq_len).alias("inputs"),
                        F.array_repeat(F.lit(IGNORE_LABEL_ID), seq_len).alias("labels"),
                        F.lit(blank_id).alias("puzzle_identifier"), F.lit(True).alias("is_pad"))
    return real.unionByName(pads)


def attach_identifiers(examples: DataFrame, identifiers: DataFrame, on: str = "puzzle_name") -> DataFrame:
    """Puzzle identifier per example (equi-join on the stored name)."""
    return examples.join(identifiers.withColumnRenamed("puzzle_name", on), on)
