"""Augmentation-aware voting, ranking, pass@K and submissions.

The reference gathers every prediction to one process and votes in a loop;
here the gather is a shuffle on (name, input_hash, pred_hash) with partial
aggregation, and ranking uses a row_number limited to the largest K so Spark
inserts a per-task group limit before the shuffle (a hot test pair sends at
most K candidates per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.functions import grid_arrow as GA
from tessera.functions.scoring import sigmoid

PASS_KS = (1, 2, 5, 10, 100, 1000)


def decode_predictions(preds: DataFrame, identifiers: DataFrame, blank_id: int = 0, with_grid: bool = True) -> DataFrame:
    """Drop blank rows, name -> (base, tid, perm), crop and un-augment, hash.

    Returns (name, input_hash, pred_hash, pred_grid, q), without ``pred_grid`` where only votes are
    wanted: images are decoded a batch at a time, and grids that nobody reads aren't built.
    """
    p = preds.select("puzzle_identifier", "inputs", "preds", "q_halt_logits") \
        .filter(F.col("puzzle_identifier") != blank_id)
    p = p.join(identifiers.select("puzzle_identifier", "puzzle_name"), "puzzle_identifier")
    base, tid, perm = G.parse_aug(F.col("puzzle_name"))
    p = p.select(base.alias("name"), tid.alias("tid"), perm.alias("perm"), "inputs", "preds",
                 sigmoid(F.col("q_halt_logits").cast("double")).alias("q"))
    out = GA.decoded(p, ["name", "q"], {"input": "inputs", "pred": "preds"}, ("pred",) if with_grid else ())
    return out.select("name", "input_hash", "pred_hash", *(["pred_grid"] if with_grid else []), "q")


def vote_table(decoded: DataFrame, with_grid: bool = True) -> DataFrame:
    """E5: votes and mean q per (name, input_hash, pred_hash); E12 is this shuffle."""
    aggs = [F.count("*").alias("votes"), F.avg("q").alias("mean_q")]
    if with_grid:
        aggs.append(F.any_value("pred_grid").alias("grid"))
    return decoded.groupBy("name", "input_hash", "pred_hash").agg(*aggs)


def _rank_window():
    return Window.partitionBy("name", "input_hash").orderBy(
        F.col("votes").desc(), F.col("mean_q").desc(), F.col("pred_hash"))


def rank_votes(votes: DataFrame, top: int | None = None) -> DataFrame:
    """Rank per test pair by (votes desc, mean q desc), ties by pred_hash."""
    r = votes.withColumn("rank", F.row_number().over(_rank_window()))
    if top is not None:
        r = r.filter(F.col("rank") <= top)
    return r


def truth_table(puzzles: DataFrame) -> DataFrame:
    """Hashes of every held-out pair (role = test), with its pair index."""
    t = puzzles.filter(F.col("role") == "test")
    return t.select(F.col("puzzle_name").alias("name"), "ex_idx",
                    G.grid_hash(F.col("input")).alias("input_hash"),
                    G.grid_hash(F.col("output")).alias("label_hash"))


def pass_at_k(votes: DataFrame, truth: DataFrame, ks=PASS_KS) -> DataFrame:
    """E8 + E9: (k, pass_at_k).

    A pair scores for K when its label is among its top K predictions; a
    puzzle's score is the mean over all its held-out pairs (unanswered = 0);
    the result is the mean over held-out puzzles.
    """
    kmax = max(ks)
    ranked = rank_votes(votes.select("name", "input_hash", "pred_hash", "votes", "mean_q"), top=kmax)
    hit = truth.join(ranked.select("name", "input_hash", F.col("pred_hash").alias("label_hash"), "rank"),
                     ["name", "input_hash", "label_hash"], "left")
    kcol = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    per_pair = hit.select("name", "ex_idx", "rank", kcol)
    per_puzzle = per_pair.groupBy("name", "k").agg(
        F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("frac"))
    return per_puzzle.groupBy("k").agg(F.round(F.avg("frac"), 6).alias("pass_at_k"))


def submission(votes: DataFrame, truth: DataFrame, k: int = 2, decoded: DataFrame | None = None) -> DataFrame:
    """Per answered test pair, the top-K grids, padded by repeating the first.

    Returns (name, ex_idx, attempt, pred_hash, grid) with attempt 1..K. When the
    vote table carries no grids, they are fetched from ``decoded`` for the top-K
    hashes only (semi-join first, so the array-valued aggregate sees few rows).
    That avoids a sort-based aggregate over every prediction, but recomputes
    ``decoded`` unless it is stored: use it when decoded predictions are a table.
    """
    ranked = rank_votes(votes.drop("grid") if decoded is not None else votes, top=k)
    if decoded is not None:
        winners = ranked.select("pred_hash").distinct()
        grids = decoded.select("pred_hash", "pred_grid").join(winners, "pred_hash", "left_semi") \
            .groupBy("pred_hash").agg(F.any_value("pred_grid").alias("grid"))
        ranked = ranked.join(grids, "pred_hash")
    pairs = truth.select("name", "ex_idx", "input_hash").join(ranked, ["name", "input_hash"])
    n = F.max("rank").over(Window.partitionBy("name", "ex_idx"))
    pairs = pairs.withColumn("n_ranked", n)
    slots = pairs.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(k))))
    # attempt a uses rank a when it exists, else rank 1
    keep = (F.col("rank") == F.col("attempt")) | ((F.col("attempt") > F.col("n_ranked")) & (F.col("rank") == 1))
    return slots.filter(keep).select("name", "ex_idx", "attempt", "pred_hash", "grid")


def submission_json(sub: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """K6: one JSON document per puzzle: name -> [{attempt_1: grid, ...} per pair].

    With ``truth``, every held-out puzzle is in it, the unanswered with an empty list.
    """
    per_pair = sub.groupBy("name", "ex_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.concat(F.lit("attempt_"), F.col("attempt").cast("string")).alias("k"),
                 F.col("grid").alias("v"))))).alias("attempts"))
    per_pair = per_pair.select("name", "ex_idx", F.to_json("attempts").alias("j"))
    per_name = per_pair.groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ex_idx", "j"))), lambda s: s["j"]).alias("pairs"))
    if truth is not None:
        per_name = truth.select("name").distinct().join(per_name, "name", "left")
    pairs = F.coalesce(F.array_join("pairs", ","), F.lit(""))
    return per_name.select("name", F.concat(F.lit("["), pairs, F.lit("]")).alias("json"))


def coverage(decoded_or_votes: DataFrame, truth: DataFrame) -> DataFrame:
    """Held-out pairs with no prediction at all."""
    seen = decoded_or_votes.select("name", "input_hash").distinct()
    return truth.join(seen, ["name", "input_hash"], "left_anti")
