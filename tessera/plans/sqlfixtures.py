"""DuckDB CTE text for the fixture adapters (F1, F2), shared by the oracles."""

from __future__ import annotations

from tessera.plans import sqlexpr as X

SEED = 42
N_AUG = 8

GRIDS = f"""
grids AS (
  SELECT vec_id, vec_id // 4 AS puzzle_id, CAST((vec_id % 4) // 2 AS INTEGER) AS ex_idx,
         CAST(vec_id % 2 AS INTEGER) AS is_output,
         list_transform(range((len(embedding) + ww - 1) // ww), lambda r: list_transform(range(ww),
           lambda c: coalesce(CAST(least(9, floor(abs(CAST(embedding[r * ww + c + 1] AS DOUBLE)) * 20)) AS INTEGER), 0))) AS grid
  FROM (SELECT *, [8, 16, 4][vec_id % 3 + 1] AS ww FROM embeddings)),
pairs AS (
  SELECT puzzle_id, 'p' || CAST(puzzle_id AS VARCHAR) AS puzzle_name, ex_idx,
         CASE WHEN ex_idx = 0 THEN 'train' ELSE 'test' END AS role,
         min_by(grid, is_output) AS input, max_by(grid, is_output) AS output
  FROM grids GROUP BY puzzle_id, ex_idx HAVING count(*) = 2)"""

PLAN = f"""
plan0 AS (
  SELECT k.puzzle_id, k.puzzle_name, a.aug_idx,
         CASE WHEN a.aug_idx = 0 THEN 0 ELSE CAST({X.h(SEED, "'tid'", 'k.puzzle_id', 'a.aug_idx')} % 8 AS INTEGER) END AS tid,
         CASE WHEN a.aug_idx = 0 THEN range(10) ELSE {X.colour_perm(SEED, "'perm'", 'k.puzzle_id', 'a.aug_idx')} END AS perm
  FROM (SELECT DISTINCT puzzle_id, puzzle_name FROM pairs) k, range({N_AUG}) a(aug_idx)),
plan AS (
  SELECT *, CASE WHEN aug_idx = 0 THEN puzzle_name
                 ELSE puzzle_name || '|||t' || CAST(tid AS VARCHAR) || '|||' || array_to_string(perm, '') END AS aug_name,
         CAST(puzzle_id * {N_AUG} + aug_idx + 1 AS INTEGER) AS puzzle_identifier
  FROM plan0)"""

PREDICTIONS = f"""
ptest AS (SELECT * FROM pairs WHERE role = 'test'),
pt AS (
  SELECT t.puzzle_id, p.aug_idx, p.tid, p.perm,
         CASE WHEN {X.h(SEED, "'blank'", 't.puzzle_id', 'p.aug_idx')} % 20 = 0 THEN 0 ELSE p.puzzle_identifier END AS puzzle_identifier,
         t.input, t.output,
         {X.h(SEED, "'pred'", 't.puzzle_id', 'p.aug_idx')} AS u,
         {X.h(SEED, "'noise'", 't.puzzle_id', 'p.aug_idx')} AS noise,
         ({X.h(SEED, "'q'", 't.puzzle_id', 'p.aug_idx')} % 2000) / 1000.0 - 1.0 AS q_halt_logits
  FROM ptest t JOIN plan p ON p.puzzle_id = t.puzzle_id WHERE {X.h(SEED, "'unanswered'", 't.puzzle_id')} % 10 <> 0),
pt2 AS (
  SELECT pt.*, coalesce(d.output, pt.output) AS pred
  FROM pt LEFT JOIN ptest d
    ON d.puzzle_id = CASE WHEN pt.u % 100 < 60 THEN pt.puzzle_id ELSE pt.puzzle_id + 1 + pt.u % 3 END),
pt3 AS (
  SELECT puzzle_id, aug_idx, puzzle_identifier, q_halt_logits, noise,
         {X.augment('input', 'tid', 'perm')} AS in_aug,
         {X.augment('output', 'tid', 'perm')} AS out_aug,
         {X.augment('pred', 'tid', 'perm')} AS pred_aug
  FROM pt2),
predictions AS (
  SELECT 'all' AS set_name, puzzle_id, aug_idx, puzzle_identifier, q_halt_logits,
         {X.serialise('in_aug')} AS inputs,
         {X.serialise('out_aug')} AS labels,
         CASE WHEN noise % 10 = 0
              THEN list_transform({X.serialise('pred_aug')}, lambda x, i: CASE WHEN i - 1 = noise % 900 THEN 1 ELSE x END)
              ELSE {X.serialise('pred_aug')} END AS preds
  FROM pt3),
identifiers AS (SELECT puzzle_identifier, aug_name AS puzzle_name FROM plan)"""

DECODED = f"""
dec0 AS (
  SELECT string_split(i.puzzle_name, '|||') AS parts, contains(i.puzzle_name, '|||') AS has_aug,
         i.puzzle_name, p.inputs, p.preds, 1.0 / (1.0 + exp(-CAST(p.q_halt_logits AS DOUBLE))) AS q
  FROM predictions p JOIN identifiers i ON i.puzzle_identifier = p.puzzle_identifier
  WHERE p.puzzle_identifier <> 0),
dec1 AS (
  SELECT CASE WHEN has_aug THEN parts[1] ELSE puzzle_name END AS name,
         CASE WHEN has_aug THEN CAST(substr(parts[-2], 2) AS INTEGER) ELSE 0 END AS tid,
         CASE WHEN has_aug THEN list_transform(range(1, length(parts[-1]) + 1), lambda i: CAST(substr(parts[-1], i, 1) AS INTEGER))
              ELSE range(10) END AS perm,
         q, {X.crop('inputs')} AS in_crop, {X.crop('preds')} AS pred_crop
  FROM dec0),
dec2 AS (
  SELECT name, q, {X.unaugment('in_crop', 'tid', 'perm')} AS input_grid,
         {X.unaugment('pred_crop', 'tid', 'perm')} AS pred_grid
  FROM dec1),
decoded AS (
  SELECT name, {X.grid_hash('input_grid')} AS input_hash, {X.grid_hash('pred_grid')} AS pred_hash, pred_grid, q
  FROM dec2),
votes AS (
  SELECT name, input_hash, pred_hash, count(*) AS votes, avg(q) AS mean_q, any_value(pred_grid) AS grid
  FROM decoded GROUP BY name, input_hash, pred_hash),
truth AS (
  SELECT puzzle_name AS name, ex_idx, {X.grid_hash('input')} AS input_hash, {X.grid_hash('output')} AS label_hash
  FROM pairs WHERE role = 'test'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name, input_hash ORDER BY votes DESC, mean_q DESC, pred_hash) AS rank
  FROM votes)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)
