"""Registered grid queries (G1-G10, G14, A1/A2/A6, R8) over the F1 grid fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.functions.rng import colour_perm, h
from tessera.operators import augment as A
from tessera.operators import sampling as R
from tessera.plans import fixtures as FX
from tessera.plans import sqlexpr as X
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import GRIDS, PLAN, SEED, with_ctes

_G = with_ctes(GRIDS)


@register("grid_dihedral", _G + """
SELECT vec_id, t.tid, to_json(""" + X.dihedral("grid", "t.tid") + """)::VARCHAR AS grid_json
FROM grids, (SELECT CAST(unnest(range(8)) AS INTEGER) AS tid) t""")
def grid_dihedral(spark, sf_dir):
    g = FX.embedding_grids(spark, sf_dir)
    g = g.withColumn("tid", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return g.select("vec_id", "tid", F.to_json(G.dihedral(F.col("grid"), F.col("tid"))).alias("grid_json"))


@register("grid_inverse", _G + """,
t AS (SELECT vec_id, grid, tid, """ + X.dihedral("grid", "tid") + """ AS aug
      FROM grids, (SELECT CAST(unnest(range(8)) AS INTEGER) AS tid) x)
SELECT vec_id, tid, """ + X.grid_hash("aug") + """ AS aug_hash,
       to_json(""" + X.dihedral("aug", X.inverse_tid("tid")) + """)::VARCHAR = to_json(grid)::VARCHAR AS roundtrip_ok
FROM t""")
def grid_inverse(spark, sf_dir):
    g = FX.embedding_grids(spark, sf_dir).withColumn("tid", F.explode(F.sequence(F.lit(0), F.lit(7))))
    g = g.withColumn("aug", G.dihedral(F.col("grid"), F.col("tid")))
    back = G.inverse_dihedral(F.col("aug"), F.col("tid"))
    return g.select("vec_id", "tid", G.grid_hash(F.col("aug")).alias("aug_hash"),
                    (F.to_json(back) == F.to_json(F.col("grid"))).alias("roundtrip_ok"))


@register("grid_recolour", _G + """,
t AS (SELECT vec_id, grid, """ + X.colour_perm(SEED, "'colour'", "vec_id") + """ AS perm FROM grids),
u AS (SELECT vec_id, grid, perm, """ + X.recolour("grid", "perm") + """ AS rec, """ + X.inverse_perm("perm") + """ AS inv FROM t)
SELECT vec_id, array_to_string(perm, '') AS perm, array_to_string(inv, '') AS inv_perm,
       to_json(rec)::VARCHAR AS grid_json,
       to_json(""" + X.recolour("rec", "inv") + """)::VARCHAR = to_json(grid)::VARCHAR AS roundtrip_ok
FROM u""")
def grid_recolour(spark, sf_dir):
    g = FX.embedding_grids(spark, sf_dir)
    g = g.withColumn("perm", colour_perm(SEED, "colour", F.col("vec_id")))
    g = g.withColumn("rec", G.recolour(F.col("grid"), F.col("perm"))).withColumn("inv", G.inverse_perm(F.col("perm")))
    return g.select("vec_id", F.array_join("perm", "").alias("perm"), F.array_join("inv", "").alias("inv_perm"),
                    F.to_json("rec").alias("grid_json"),
                    (F.to_json(G.recolour(F.col("rec"), F.col("inv"))) == F.to_json("grid")).alias("roundtrip_ok"))


@register("grid_hash", _G + """
SELECT vec_id, CAST(len(grid) AS INTEGER) AS h, CAST(len(grid[1]) AS INTEGER) AS w, """ + X.grid_hash("grid") + """ AS grid_hash
FROM grids""")
def grid_hash(spark, sf_dir):
    g = FX.embedding_grids(spark, sf_dir)
    return g.select("vec_id", G.height(F.col("grid")).alias("h"), G.width(F.col("grid")).alias("w"),
                    G.grid_hash(F.col("grid")).alias("grid_hash"))


@register("aug_name_parse", with_ctes(GRIDS, PLAN) + """,
parsed AS (SELECT puzzle_identifier, aug_name, string_split(aug_name, '|||') AS parts, contains(aug_name, '|||') AS has FROM plan)
SELECT puzzle_identifier, aug_name,
       CASE WHEN has THEN parts[1] ELSE aug_name END AS base,
       CASE WHEN has THEN CAST(substr(parts[-2], 2) AS INTEGER) ELSE 0 END AS tid,
       CASE WHEN has THEN parts[-1] ELSE '0123456789' END AS perm,
       CASE WHEN has THEN array_to_string(""" + X.inverse_perm(
    "list_transform(range(1, 11), lambda i: CAST(substr(parts[-1], i, 1) AS INTEGER))") + """, '')
            ELSE '0123456789' END AS inv_perm
FROM parsed""")
def aug_name_parse(spark, sf_dir):
    plan = FX.augmentation_plan(FX.grid_puzzles(spark, sf_dir))
    base, tid, perm = G.parse_aug(F.col("aug_name"))
    return plan.select("puzzle_identifier", "aug_name", base.alias("base"), tid.alias("tid"),
                       F.array_join(perm, "").alias("perm"),
                       F.array_join(G.inverse_perm(perm), "").alias("inv_perm"))


_PH = """,
ph AS (SELECT puzzle_id, sha256(array_to_string(list_sort(list(""" + X.grid_hash("input") + """ || '|' || """ + \
    X.grid_hash("output") + """)), '|')) AS puzzle_hash FROM pairs GROUP BY puzzle_id)"""


@register("puzzle_hash", _G + _PH + """
SELECT puzzle_id, puzzle_hash FROM ph""")
def puzzle_hash(spark, sf_dir):
    return A.puzzle_hashes(FX.grid_puzzles(spark, sf_dir))


AUG_N = 8


_KEPT = f""",
tr0 AS (
  SELECT k.puzzle_id, t.trial,
         CAST({X.h(SEED, "'tid'", 'k.puzzle_id', 't.trial')} % 8 AS INTEGER) AS tid,
         {X.colour_perm(SEED, "'perm'", 'k.puzzle_id', 't.trial')} AS perm
  FROM (SELECT DISTINCT puzzle_id FROM pairs) k, range(1, {5 * AUG_N + 1}) t(trial)),
tr AS (SELECT puzzle_id, tid, perm, min(trial) AS trial FROM tr0 GROUP BY puzzle_id, tid, perm),
ex AS (SELECT tr.puzzle_id, tr.trial, {X.augment('p.input', 'tr.tid', 'tr.perm')} AS ai,
              {X.augment('p.output', 'tr.tid', 'tr.perm')} AS ao
       FROM tr JOIN pairs p ON p.puzzle_id = tr.puzzle_id),
th AS (SELECT puzzle_id, trial, sha256(array_to_string(list_sort(list({X.grid_hash('ai')} || '|' || {X.grid_hash('ao')})), '|')) AS puzzle_hash
       FROM ex GROUP BY puzzle_id, trial),
cand AS (SELECT th.puzzle_id, th.puzzle_hash, min(th.trial) AS trial FROM th JOIN ph ON ph.puzzle_id = th.puzzle_id
         WHERE th.puzzle_hash <> ph.puzzle_hash GROUP BY th.puzzle_id, th.puzzle_hash),
kept AS (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY trial) AS aug_idx FROM cand)"""


@register("augment_dedup", _G + _PH + _KEPT + f"""
SELECT k.puzzle_id, CAST(k.aug_idx AS INTEGER) AS aug_idx, CAST(k.trial AS INTEGER) AS trial, tr.tid, array_to_string(tr.perm, '') AS perm, k.puzzle_hash
FROM kept k JOIN tr ON tr.puzzle_id = k.puzzle_id AND tr.trial = k.trial WHERE k.aug_idx <= {AUG_N}
UNION ALL
SELECT puzzle_id, 0, 0, 0, '0123456789', puzzle_hash FROM ph""")
def augment_dedup(spark, sf_dir):
    group, _ = A.augment_puzzles(FX.grid_puzzles(spark, sf_dir), AUG_N, SEED)
    return group.select("puzzle_id", F.col("aug_idx").cast("int"), F.col("trial").cast("int"), "tid",
                        F.array_join("perm", "").alias("perm"), "puzzle_hash")


@register("grid_serialise", _G + f""",
ex AS (SELECT *, {X.h(SEED, 'puzzle_id', 'ex_idx')} AS hk FROM pairs),
exm AS (SELECT puzzle_id, arg_min(ex_idx, hk * 1024 + ex_idx) AS ex_exempt FROM ex GROUP BY puzzle_id),
off AS (
  SELECT ex.*, ex.ex_idx = exm.ex_exempt AS exempt,
         CASE WHEN ex.ex_idx = exm.ex_exempt THEN 0 ELSE CAST({X.h(SEED, "'pad_r'", 'ex.puzzle_id', 'ex.ex_idx')} % (31 - greatest(len(input), len(output))) AS INTEGER) END AS pad_r,
         CASE WHEN ex.ex_idx = exm.ex_exempt THEN 0 ELSE CAST({X.h(SEED, "'pad_c'", 'ex.puzzle_id', 'ex.ex_idx')} % (31 - greatest(len(input[1]), len(output[1]))) AS INTEGER) END AS pad_c
  FROM ex JOIN exm ON exm.puzzle_id = ex.puzzle_id)
SELECT puzzle_id, ex_idx, exempt, pad_r, pad_c,
       array_to_string({X.serialise('input', 'pad_r', 'pad_c')}, ',') AS inputs,
       array_to_string({X.serialise('output', 'pad_r', 'pad_c')}, ',') AS labels
FROM off""")
def grid_serialise(spark, sf_dir):
    """G8 + G9 + R8: translated token images; one seeded example per puzzle keeps offset 0."""
    p = FX.grid_puzzles(spark, sf_dir)
    p = R.mark_exempt(p, "puzzle_id", SEED, "ex_idx")
    pr = F.when(F.col("exempt"), F.lit(0)).otherwise(F.pmod(h(SEED, "pad_r", F.col("puzzle_id"), F.col("ex_idx")),
                                                           31 - F.greatest(G.height(F.col("input")), G.height(F.col("output")))).cast("int"))
    pc = F.when(F.col("exempt"), F.lit(0)).otherwise(F.pmod(h(SEED, "pad_c", F.col("puzzle_id"), F.col("ex_idx")),
                                                           31 - F.greatest(G.width(F.col("input")), G.width(F.col("output")))).cast("int"))
    p = p.withColumn("pad_r", pr).withColumn("pad_c", pc)
    return p.select("puzzle_id", "ex_idx", "exempt", "pad_r", "pad_c",
                    F.array_join(G.serialise(F.col("input"), F.col("pad_r"), F.col("pad_c")), ",").alias("inputs"),
                    F.array_join(G.serialise(F.col("output"), F.col("pad_r"), F.col("pad_c")), ",").alias("labels"))


@register("grid_crop_roundtrip", _G + f""",
s AS (SELECT vec_id, grid, {X.serialise('grid')} AS seq, {X.h(SEED, "'crop'", 'vec_id')} AS u FROM grids),
n AS (SELECT vec_id, grid, seq, list_transform(seq, lambda x, i: CASE WHEN i - 1 = u % 900 THEN CAST(u % 2 AS INTEGER) ELSE x END) AS noisy FROM s)
SELECT vec_id, to_json({X.crop('seq')})::VARCHAR = to_json(grid)::VARCHAR AS roundtrip_ok,
       to_json({X.crop('noisy')})::VARCHAR AS noisy_crop_json
FROM n""")
def grid_crop_roundtrip(spark, sf_dir):
    """crop(serialise(g)) == g, and the crop of a sequence with one token knocked out."""
    g = FX.embedding_grids(spark, sf_dir)
    u = h(SEED, "crop", F.col("vec_id"))
    g = g.select("vec_id", "grid", G.serialise(F.col("grid")).alias("seq"), u.alias("u"))
    g = g.withColumn("noisy", F.transform("seq", lambda x, i: F.when(i == F.pmod(F.col("u"), F.lit(900)),
                                                                     (F.col("u") % 2).cast("int")).otherwise(x)))
    return g.select("vec_id", (F.to_json(G.crop(F.col("seq"))) == F.to_json("grid")).alias("roundtrip_ok"),
                    F.to_json(G.crop(F.col("noisy"))).alias("noisy_crop_json"))


_EX = """,
grp AS (SELECT k.puzzle_id, k.aug_idx, tr.tid, tr.perm FROM kept k JOIN tr ON tr.puzzle_id = k.puzzle_id AND tr.trial = k.trial WHERE k.aug_idx <= """ + str(AUG_N) + """
        UNION ALL SELECT puzzle_id, 0, 0, range(10) FROM ph),
names AS (SELECT DISTINCT g.*, CASE WHEN aug_idx = 0 THEN p.puzzle_name ELSE p.puzzle_name || '|||t' || CAST(tid AS VARCHAR) || '|||' || array_to_string(perm, '') END AS name
          FROM grp g JOIN pairs p ON p.puzzle_id = g.puzzle_id),
numbered AS (SELECT *, row_number() OVER (ORDER BY puzzle_id, aug_idx, name) AS ident FROM names),
rows AS (SELECT CASE WHEN p.role = 'train' OR p.puzzle_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, n.puzzle_id, n.name, n.ident, p.ex_idx,
                """ + X.augment('p.input', 'n.tid', 'n.perm') + """ AS input, """ + X.augment('p.output', 'n.tid', 'n.perm') + """ AS output
         FROM numbered n JOIN pairs p ON p.puzzle_id = n.puzzle_id),
spare AS (SELECT split, name, arg_min(ex_idx, {'h': """ + X.h(SEED, 'name', 'split', 'ex_idx') + """, 'i': ex_idx}) AS ex FROM rows GROUP BY split, name),
placed AS (SELECT r.*, CASE WHEN r.split <> 'train' OR r.ex_idx = s.ex THEN 0 ELSE CAST(""" + X.h(SEED, "'pad_r'", "r.name || ':' || r.ex_idx") + """ % (31 - greatest(len(input), len(output))) AS INTEGER) END AS pr,
                  CASE WHEN r.split <> 'train' OR r.ex_idx = s.ex THEN 0 ELSE CAST(""" + X.h(SEED, "'pad_c'", "r.name || ':' || r.ex_idx") + """ % (31 - greatest(len(input[1]), len(output[1]))) AS INTEGER) END AS pc
           FROM rows r JOIN spare s ON s.split = r.split AND s.name = r.name),
meta AS (SELECT split, count(DISTINCT puzzle_id) AS total_groups, count(DISTINCT name) AS total_puzzles, count(*) / count(DISTINCT name) AS mean_examples FROM rows GROUP BY split)"""


@register("build_corpus", _G + _PH + _KEPT + _EX + f"""
SELECT p.split, 'all' AS set_name, p.name AS puzzle_name, CAST(ident AS INTEGER) AS puzzle_identifier, p.ex_idx,
       md5(array_to_string({X.serialise('input', 'pr', 'pc')}, ',')) AS inputs_md5, md5(array_to_string({X.serialise('output', 'pr', 'pc')}, ',')) AS labels_md5,
       total_groups, total_puzzles, round(mean_examples, 6) AS mean_puzzle_examples, CAST((SELECT max(ident) + 1 FROM numbered) AS BIGINT) AS num_puzzle_identifiers, true AS consistent
FROM placed p JOIN meta ON meta.split = p.split""")
def build_corpus(spark, sf_dir):
    """A1 -> G5 -> D2 -> R8 -> G9 -> G8 -> K1-K4, then S9 + S10 + metadata + D6: the corpus built, written and read back."""
    from tessera.operators import corpus as C
    from tessera.streaming.state import scratch_path
    p = FX.grid_puzzles(spark, sf_dir)
    p = p.withColumn("split", F.when((F.col("role") == "train") | (F.col("puzzle_id") % 2 == 0), "train").otherwise("test"))
    path = scratch_path(spark, "corpus")
    C.build_corpus(p, path, AUG_N, SEED)
    r = C.load_corpus(spark, path)
    return r.select("split", "set_name", "puzzle_name", "puzzle_identifier", "ex_idx", F.md5(F.array_join("inputs", ",")).alias("inputs_md5"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"), "total_groups", "total_puzzles",
                    F.round("mean_puzzle_examples", 6).alias("mean_puzzle_examples"), F.col("num_puzzle_identifiers").cast("long").alias("num_puzzle_identifiers"), "consistent")
