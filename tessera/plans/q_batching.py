"""Registered batch-planning queries (B1-B7) on the F8 shape:
group = customer, puzzle = order (size = its line count), example = line."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import batching as B
from tessera.plans import fixtures as FX
from tessera.plans import sqlexpr as X
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import SEED

EPOCHS, ITER, BATCH = 2, 1, 32


def _order_plan(spark, sf_dir):
    l = FX.table(spark, sf_dir, "lineitem").select("l_orderkey")
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sizes = l.groupBy("l_orderkey").agg(F.count("*").alias("size"))
    puzzles = o.join(sizes, o.o_orderkey == sizes.l_orderkey).select("o_custkey", "o_orderkey", "size")
    order = B.epoch_order(puzzles, "o_custkey", EPOCHS, SEED, ITER)
    return B.pick_puzzles(order, puzzles, "o_custkey", "o_orderkey", SEED, ITER)


_PLAN_SQL = f"""
sz AS (SELECT l_orderkey AS o_orderkey, count(*) AS size FROM lineitem GROUP BY 1),
pz AS (SELECT o.o_custkey, o.o_orderkey, sz.size FROM orders o JOIN sz ON sz.o_orderkey = o.o_orderkey),
g AS (SELECT DISTINCT o_custkey FROM pz),
ord AS (SELECT g.o_custkey, e.epoch,
               row_number() OVER (ORDER BY e.epoch, {X.h(SEED + ITER, 'e.epoch', 'g.o_custkey')}, g.o_custkey) - 1 AS pos
        FROM g, range({EPOCHS}) e(epoch)),
pick AS (SELECT ord.pos, ord.o_custkey,
                arg_min({{'p': pz.o_orderkey, 's': pz.size}}, {{'k': {X.h(SEED + ITER, "'pick'", 'ord.pos', 'pz.o_orderkey')}, 'p': pz.o_orderkey}}) AS ps
         FROM ord JOIN pz ON pz.o_custkey = ord.o_custkey GROUP BY 1, 2)"""


@register("epoch_order", f"""WITH {_PLAN_SQL}
SELECT pos AS "order", o_custkey, ps.p AS o_orderkey, ps.s AS size FROM pick""")
def epoch_order(spark, sf_dir):
    """B1 + R6: two seeded permutations of customers, one seeded order per slot."""
    return _order_plan(spark, sf_dir).select("order", "o_custkey", "o_orderkey", "size")


@register("pack_greedy", f"""WITH RECURSIVE {_PLAN_SQL},
t AS MATERIALIZED (SELECT pos, o_custkey, ps.p AS o_orderkey, ps.s AS size,
             sum(ps.s) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS I FROM pick),
t2 AS MATERIALIZED (SELECT *, I - size AS S FROM t),
n AS MATERIALIZED (SELECT count(*) AS n FROM t2),
nx AS MATERIALIZED (SELECT a.pos AS s, coalesce(min(b.pos) + 1, (SELECT n FROM n)) AS nt
       FROM t2 a LEFT JOIN t2 b ON b.I >= a.S + {BATCH} GROUP BY a.pos),
chain AS (SELECT CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS batch_id
          UNION ALL
          SELECT nx.nt, chain.batch_id + 1 FROM chain JOIN nx ON nx.s = chain.s WHERE nx.nt < (SELECT n FROM n)),
cs AS (SELECT chain.s, chain.batch_id, t2.S AS S0 FROM chain JOIN t2 ON t2.pos = chain.s),
m AS (SELECT t2.*, cs.batch_id, cs.S0 FROM t2 ASOF JOIN cs ON t2.pos >= cs.s),
closed AS (SELECT batch_id FROM m GROUP BY batch_id HAVING max(CASE WHEN I >= S0 + {BATCH} THEN 1 ELSE 0 END) = 1)
SELECT pos AS "order", o_custkey, o_orderkey, batch_id, CAST(least(size, S0 + {BATCH} - S) AS INTEGER) AS take,
       CAST(S - S0 AS BIGINT) AS slot_start
FROM m WHERE batch_id IN (SELECT batch_id FROM closed)""")
def pack_greedy(spark, sf_dir):
    """B2 + B3: greedy packing with truncation into batches of 32, last short batch dropped."""
    plan = _order_plan(spark, sf_dir)
    packed = B.pack_batches(plan.select("order", "size"), BATCH)
    return packed.join(plan, "order").select("order", "o_custkey", "o_orderkey", "batch_id", "take", "slot_start")


_LORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate"]
EVAL_B, REPLICAS = 64, 2


@register("collate", f"""
WITH e AS (SELECT row_number() OVER (ORDER BY {", ".join(_LORDER)}) - 1 AS pos, l_linenumber, l_partkey, l_orderkey FROM lineitem),
b AS (SELECT pos // {EVAL_B} AS batch_id, CAST((pos % {EVAL_B}) // {EVAL_B // REPLICAS} AS INTEGER) AS rank,
             CAST(pos % {EVAL_B // REPLICAS} AS INTEGER) AS local_slot, false AS is_pad, CAST(l_orderkey AS INTEGER) AS puzzle_identifier,
             CAST(CASE WHEN l_partkey % 10 = 0 THEN -100 ELSE l_partkey % 10 END AS VARCHAR) AS labels
      FROM e),
ranks AS (SELECT DISTINCT batch_id, CAST(r.rank AS INTEGER) AS rank FROM b, range({REPLICAS}) r(rank)),
cnt AS (SELECT ranks.batch_id, ranks.rank, count(b.local_slot) AS n FROM ranks LEFT JOIN b USING (batch_id, rank) GROUP BY 1, 2),
pads AS (SELECT batch_id, rank, CAST(unnest(range(n, {EVAL_B // REPLICAS})) AS INTEGER) AS local_slot FROM cnt WHERE n < {EVAL_B // REPLICAS})
SELECT * FROM b
UNION ALL SELECT batch_id, rank, local_slot, true, 0, '-100' FROM pads""")
def collate(spark, sf_dir):
    """Sequential eval batches of 64 over all lines, 2 ranks, ignore 0 -> -100, pads."""
    l = FX.table(spark, sf_dir, "lineitem").select(*_LORDER)
    e = B.eval_batches(l, _LORDER, EVAL_B, REPLICAS)
    e = e.select("batch_id", "rank", "local_slot", F.array(F.col("l_linenumber")).alias("inputs"),
                 F.array((F.col("l_partkey") % 10).cast("int")).alias("labels"),
                 F.col("l_orderkey").cast("int").alias("puzzle_identifier"))
    c = B.collate(e, EVAL_B, REPLICAS, seq_len=1, ignore_label_id=0)
    return c.select(F.col("batch_id").cast("long"), "rank", "local_slot", "is_pad", "puzzle_identifier",
                    F.array_join("labels", ",").alias("labels"))


SETS, TRAIN_B = ["set_0", "set_1"], 32
_EKEY = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate"]


def _set_sql(k: int) -> str:
    """CTEs of one set: plan, packing as in pack_greedy, and drawn examples."""
    it = ITER + k
    return f"""
ex{k} AS (SELECT * FROM ex WHERE set_name = '{SETS[k]}'),
pz{k} AS (SELECT o_custkey, o_orderkey, count(*) AS size FROM ex{k} GROUP BY 1, 2),
ord{k} AS (SELECT g.o_custkey, row_number() OVER (ORDER BY e.epoch, {X.h(SEED + it, 'e.epoch', 'g.o_custkey')}, g.o_custkey) - 1 AS pos
          FROM (SELECT DISTINCT o_custkey FROM pz{k}) g, range({EPOCHS}) e(epoch)),
pick{k} AS (SELECT o.pos, arg_min({{'p': pz.o_orderkey, 's': pz.size}}, {{'k': {X.h(SEED + it, "'pick'", 'o.pos', 'pz.o_orderkey')}, 'p': pz.o_orderkey}}) AS ps
           FROM ord{k} o JOIN pz{k} pz ON pz.o_custkey = o.o_custkey GROUP BY 1),
t{k} AS MATERIALIZED (SELECT pos, ps.p AS o_orderkey, ps.s AS size, sum(ps.s) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS I FROM pick{k}),
nx{k} AS MATERIALIZED (SELECT a.pos AS s, coalesce(min(b.pos) + 1, (SELECT count(*) FROM t{k})) AS nt
       FROM t{k} a LEFT JOIN t{k} b ON b.I >= a.I - a.size + {TRAIN_B} GROUP BY a.pos),
chain{k} AS (SELECT CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS batch_id
          UNION ALL SELECT nx.nt, c.batch_id + 1 FROM chain{k} c JOIN nx{k} nx ON nx.s = c.s WHERE nx.nt < (SELECT count(*) FROM t{k})),
cs{k} AS (SELECT c.s, c.batch_id, t.I - t.size AS S0 FROM chain{k} c JOIN t{k} t ON t.pos = c.s),
m{k} AS (SELECT t.*, cs.batch_id, cs.S0 FROM t{k} t ASOF JOIN cs{k} cs ON t.pos >= cs.s),
full{k} AS (SELECT batch_id FROM m{k} GROUP BY batch_id HAVING max(I) >= max(S0) + {TRAIN_B}),
draw{k} AS (SELECT m.batch_id, m.S0, m.I, m.size, e.*,
              row_number() OVER (PARTITION BY m.pos ORDER BY {X.h(SEED + it, "'example'", 'm.pos', *[f'e.{c}' for c in _EKEY[:3]])}, {', '.join(f'e.{c}' for c in _EKEY)}) - 1 AS n
           FROM m{k} m JOIN ex{k} e ON e.o_orderkey = m.o_orderkey WHERE m.batch_id IN (SELECT batch_id FROM full{k})),
out{k} AS (SELECT *, I - size - S0 + n AS slot FROM draw{k} WHERE n < least(size, S0 + {TRAIN_B} - (I - size)))"""


_EX_SQL = f"""
ex AS (SELECT 'set_' || CAST(o.o_custkey % 2 AS VARCHAR) AS set_name, o.o_custkey, o.o_orderkey, {', '.join('l.' + c for c in _EKEY)}
       FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
ids AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS puzzle_identifier FROM (SELECT DISTINCT o_orderkey FROM ex))"""
_OUT_SQL = " UNION ALL ".join(f"SELECT set_name, batch_id, slot, o_orderkey, l_linenumber, l_partkey, l_suppkey FROM out{k}" for k in range(len(SETS)))


@register("train_batches", f"""WITH RECURSIVE {_EX_SQL}, {','.join(_set_sql(k) for k in range(len(SETS)))},
u AS ({_OUT_SQL})
SELECT set_name, batch_id, CAST(slot // {TRAIN_B // REPLICAS} AS INTEGER) AS rank, CAST(slot % {TRAIN_B // REPLICAS} AS INTEGER) AS local_slot,
       CAST(ids.puzzle_identifier AS INTEGER) AS puzzle_identifier, CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_suppkey % 10 AS VARCHAR) AS inputs,
       CAST(CASE WHEN l_partkey % 10 = 0 THEN -100 ELSE l_partkey % 10 END AS VARCHAR) || ',' || CAST(CASE WHEN l_suppkey % 10 = 0 THEN -100 ELSE l_suppkey % 10 END AS VARCHAR) AS labels
FROM u JOIN ids ON ids.o_orderkey = u.o_orderkey""")
def train_batches(spark, sf_dir):
    """B1 -> R6 -> B2 -> R7 -> B5 -> B6 -> B7 over two sets of orders: every training row with its rank, slot and identifier."""
    from tessera.operators.ids import identifier_map
    from tessera.session import materialise
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = FX.table(spark, sf_dir, "lineitem").select("l_orderkey", *_EKEY)
    ex = lines.join(o, lines.l_orderkey == o.o_orderkey).withColumn(
        "set_name", F.concat(F.lit("set_"), (F.col("o_custkey") % 2).cast("string"))).drop("l_orderkey")
    ids = identifier_map(ex.select("o_orderkey"), "o_orderkey", ["o_orderkey"])
    rows = materialise(_train_rows(ex).select("set_name", "batch_id", "rank", "local_slot", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = B.attach_identifiers(rows, ids, "o_orderkey")
    out = None
    for name in SETS:  # batch ids count per set
        own = rows.filter(F.col("set_name") == name).select(
            "batch_id", "rank", "local_slot", "puzzle_identifier",
            F.array(F.col("l_linenumber"), F.col("l_suppkey") % 10).alias("inputs"), F.array(F.col("l_partkey") % 10, F.col("l_suppkey") % 10).alias("labels"))
        c = B.collate(own, TRAIN_B, REPLICAS, seq_len=2, ignore_label_id=0).withColumn("set_name", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out.select("set_name", "batch_id", "rank", "local_slot", "puzzle_identifier",
                      F.array_join("inputs", ",").alias("inputs"), F.array_join("labels", ",").alias("labels"))


def _train_rows(ex):
    return B.train_batches(ex, SETS, "o_custkey", "o_orderkey", _EKEY, EPOCHS, TRAIN_B, REPLICAS, SEED, ITER, draw_key=_EKEY[:3])
