"""Registered vote-evaluation queries (E1-E12, M10) over the F1/F2 grid fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import votes as V
from tessera.plans import fixtures as FX
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import DECODED, GRIDS, PLAN, PREDICTIONS, with_ctes

_CTES = with_ctes(GRIDS, PLAN, PREDICTIONS, DECODED)


def _votes(spark, sf_dir, with_grid=False):
    preds, identifiers, puzzles = FX.grid_predictions(spark, sf_dir)
    decoded = V.decode_predictions(preds, identifiers, with_grid=with_grid)
    return V.vote_table(decoded, with_grid=with_grid), V.truth_table(puzzles), decoded


@register("vote_pass_at_k", _CTES + """,
hit AS (
  SELECT t.name, t.ex_idx, r.rank FROM truth t
  LEFT JOIN (SELECT * FROM ranked WHERE rank <= 1000) r
    ON r.name = t.name AND r.input_hash = t.input_hash AND r.pred_hash = t.label_hash),
per_puzzle AS (
  SELECT name, k, avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END) AS frac
  FROM hit, (SELECT unnest([1, 2, 5, 10, 100, 1000]) AS k) ks GROUP BY name, k)
SELECT k, round(avg(frac), 6) AS pass_at_k FROM per_puzzle GROUP BY k""")
def vote_pass_at_k(spark, sf_dir):
    """Flagship: serialise -> crop -> un-augment -> hash -> vote -> rank -> pass@K."""
    votes, truth, _ = _votes(spark, sf_dir)
    return V.pass_at_k(votes, truth)


@register("vote_table", _CTES + """
SELECT name, input_hash, pred_hash, votes, round(mean_q, 6) AS mean_q, to_json(grid)::VARCHAR AS grid_json
FROM votes""")
def vote_table(spark, sf_dir):
    votes, _, _ = _votes(spark, sf_dir, with_grid=True)
    return votes.select("name", "input_hash", "pred_hash", "votes", F.round("mean_q", 6).alias("mean_q"),
                        F.to_json("grid").alias("grid_json"))


@register("vote_rank_topk", _CTES + """
SELECT name, input_hash, pred_hash, votes, round(mean_q, 6) AS mean_q, rank FROM ranked WHERE rank <= 3""")
def vote_rank_topk(spark, sf_dir):
    votes, _, _ = _votes(spark, sf_dir)
    r = V.rank_votes(votes, top=3)
    return r.select("name", "input_hash", "pred_hash", "votes", F.round("mean_q", 6).alias("mean_q"), "rank")


@register("submission", _CTES + """,
top AS (
  SELECT t.name, t.ex_idx, r.rank, r.pred_hash, r.grid,
         max(r.rank) OVER (PARTITION BY t.name, t.ex_idx) AS n_ranked
  FROM truth t JOIN ranked r ON r.name = t.name AND r.input_hash = t.input_hash WHERE r.rank <= 2),
slots AS (SELECT top.*, a.attempt FROM top, (SELECT unnest([1, 2]) AS attempt) a)
SELECT name, ex_idx, attempt, pred_hash, to_json(grid)::VARCHAR AS grid_json FROM slots
WHERE rank = attempt OR (attempt > n_ranked AND rank = 1)""")
def submission(spark, sf_dir):
    votes, truth, _ = _votes(spark, sf_dir, with_grid=True)
    s = V.submission(votes, truth, k=2)
    return s.select("name", "ex_idx", "attempt", "pred_hash", F.to_json("grid").alias("grid_json"))


@register("vote_coverage", _CTES + """
SELECT name, ex_idx, input_hash FROM truth t
WHERE NOT EXISTS (SELECT 1 FROM decoded d WHERE d.name = t.name AND d.input_hash = t.input_hash)""")
def vote_coverage(spark, sf_dir):
    _, truth, decoded = _votes(spark, sf_dir)
    return V.coverage(decoded, truth).select("name", "ex_idx", "input_hash")
