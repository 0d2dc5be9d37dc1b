"""Mixing sources to target weights by Pfair scheduling.

Weights are whole shares a_s of a period of P = sum(a_s) slots; a slot takes one
block of documents of one source. Block k of a source (counted inside the
period) may start at floor(k * P / a_s) and is due by ceil((k + 1) * P / a_s).
Earliest deadline first among the released blocks meets every deadline, so at
any time each source is less than one block from its exact share.

The schedule of a period depends on the shares alone, not on the data: it is a
fold over P slots, and every period repeats it. Block i of a source lies in
period i div a_s, so its slot is found without going through the blocks before
it. When a source has run out, later periods use the schedule of those left, in
the same proportions; no document is dropped or repeated. There are at most as
many schedules as sources.

Documents are ordered inside their source by a digest of the id, a shuffle that
does not depend on partitioning; a source with a third of all rows is ranked in
slices. Everything is DataFrame work: no Python runs on rows.

Defined cases: null is a source like others; sources that ``weights`` leaves
out get the least share; a null or repeated doc_id, or a repeated row, is one
more document of its source, ties going by text digest; an empty table gives no
rows. Other columns are not read by ``mixing_slots``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import ranked, stored

BLOCK_ROWS = 16
PERIOD = 400


def shares(docs: DataFrame, weights: dict | None, alpha: float, period: int, block_rows: int) -> DataFrame:
    """(source, a, e): share of a period and number of periods each source lasts."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        n = n.withColumn("w", F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None), F.lit(0.0)))
    total = n.agg(F.sum("w")).first()[0] or 1.0
    share = F.greatest(F.lit(1), F.round(F.col("w") * (period / total)).cast("int"))
    return n.select("source", share.alias("a"), F.ceil(F.ceil(F.col("n") / block_rows) / share).cast("long").alias("e"))


def earliest_deadline_first(active: Column, length: Column) -> Column:
    """Index into ``active`` (array of structs with share ``a``) for each of ``length`` slots."""
    n = F.size(active)
    zero = F.struct(F.array_repeat(F.lit(0), n).alias("done"), F.array().cast("array<int>").alias("out"))

    def slot(state: Column, t: Column) -> Column:
        done = state["done"]
        released = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (done[i] < active[i]["a"]) & (F.floor(done[i] * length / active[i]["a"]) <= t))
        due = F.transform(released, lambda i: F.struct(F.ceil((done[i] + 1) * length / active[i]["a"]).alias("due"), i.alias("i")))
        pick = F.array_min(due)["i"]
        # the pick is put at the end of ``out`` first, so that it is worked out once a slot
        out = F.concat(state["out"], F.array(pick))
        return F.struct(done.alias("done"), out.alias("out"))

    def count(state: Column) -> Column:
        last = F.element_at(state["out"], -1)
        return F.struct(F.transform(state["done"], lambda d, i: d + F.when(i == last, 1).otherwise(0)).alias("done"), state["out"].alias("out"))

    def step(state: Column, t: Column) -> Column:
        return F.element_at(F.transform(F.array(slot(state, t)), count), 1)

    return F.aggregate(F.sequence(F.lit(0), length - 1), zero, step, lambda s: s["out"])


def schedules(table: DataFrame) -> DataFrame:
    """One row a source: its share and, for each phase, first period, first slot, length, and its slots in a period."""
    one = table.agg(F.sort_array(F.collect_list(F.struct("source", "a", "e"))).alias("all"))
    one = one.withColumn("starts", F.expr("slice(array_sort(array_distinct(concat(array(0L), transform(all, s -> s.e)))), 1, size(array_distinct(transform(all, s -> s.e))))"))
    phase = one.select("all", F.posexplode("starts").alias("phase", "start")).select(
        "phase", "start", F.expr("aggregate(all, 0L, (x, s) -> x + s.a * least(start, s.e))").alias("base"), F.expr("filter(all, s -> s.e > start)").alias("active"))
    phase = phase.withColumn("length", F.expr("cast(aggregate(active, 0L, (x, s) -> x + s.a) as int)"))
    phase = phase.withColumn("plan", earliest_deadline_first(F.col("active"), F.col("length")))
    each = phase.select("phase", "start", "base", "length", "plan", F.posexplode("active").alias("i", "s"))
    each = each.select(F.col("s.source").alias("_source"), F.col("s.a").alias("share"), F.struct(
        "phase", "start", "base", "length", F.expr("filter(sequence(0, length - 1), t -> plan[t] = i)").alias("slots")).alias("p"))
    return each.groupBy("_source", "share").agg(F.sort_array(F.collect_list("p")).alias("phases"))


def placed(docs: DataFrame, weights: dict | None, alpha: float, period: int, block_rows: int) -> DataFrame:
    """Structs ``row`` (the columns of ``docs``) and ``mix`` (block, release, deadline, slot, offset in the block, position)."""
    plan = stored(schedules(stored(shares(docs, weights, alpha, period, block_rows), "mix-shares")), "mix-schedules")
    order = [F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    rows = ranked(rows, ["source"], [F.col(f"_o{i}") for i in range(len(order))], "_rank")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_block", F.expr(f"_rank div {block_rows}"))
    rows = rows.withColumn("_period", F.expr("_block div share")).withColumn("_k", F.expr("cast(_block % share as int)"))
    rows = rows.withColumn("_p", F.expr("element_at(filter(phases, p -> p.start <= _period), -1)"))
    first = F.expr("_p.base + (_period - _p.start) * _p.length")
    slot = first + F.expr("_p.slots[_k]")
    offset = F.expr(f"_rank % {block_rows}")
    mix = F.struct(F.col("_block").alias("block"), (first + F.expr("(_k * _p.length) div share")).alias("release"),
                   (first + F.expr("((_k + 1) * _p.length + share - 1) div share")).alias("deadline"),
                   slot.alias("slot"), offset.alias("offset"), (slot * block_rows + offset).alias("position"))
    return rows.select("row", mix.alias("mix"))


def mixing_slots(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, period: int = PERIOD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, position), one row per row.

    ``weights``: source -> weight; without them a source weighs as its row count
    to the power ``alpha``. Positions rise in mixing order; a place stays empty
    only where a block isn't full or a source runs out inside a period.
    """
    narrow = docs.select("doc_id", "source", F.xxhash64("text").alias("text"))
    return placed(narrow, weights, alpha, period, block_rows).select("row.doc_id", "row.source", *[f"mix.{c}" for c in ("block", "release", "deadline", "slot", "position")])


def mixed(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, period: int = PERIOD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All documents with all their columns, ranged and sorted in mixing order."""
    rows = placed(docs, weights, alpha, period, block_rows)
    return rows.repartitionByRange("mix.position").sortWithinPartitions("mix.position").select("row.*")


ORACLE = f"""
with recursive n as (select source, count(*) as n, sqrt(count(*)) as w from documents group by source),
shares as (select source, n, greatest(1, cast(round(w * ({PERIOD} / (select sum(w) from n))) as bigint)) as a from n),
t as (select source, a, cast(ceil(ceil(n / {BLOCK_ROWS}) / a) as bigint) as e, row_number() over (order by source) - 1 as i from shares),
starts as (select distinct e as start from t union select 0),
phase as (select start, sum(a * least(start, e)) as base, sum(a) filter (where e > start) as len from starts, t group by start having count(*) filter (where e > start) > 0),
fold as (
  select start, cast(len as bigint) as len, cast(0 as bigint) as slot, cast(null as bigint) as pick, (select list(0 * a order by i) from t) as done from phase
  union all
  select start, len, slot + 1, pick, list_transform(done, lambda d, k: case when k - 1 = pick then d + 1 else d end) from (
    select start, len, slot, done, (select t.i from t where t.e > f.start and f.done[t.i + 1] < t.a and f.done[t.i + 1] * f.len // t.a <= f.slot
      order by ((f.done[t.i + 1] + 1) * f.len + t.a - 1) // t.a, t.i limit 1) as pick
    from fold f where f.slot < f.len)),
plan as (select start, pick as i, slot - 1 as spot, row_number() over (partition by start, pick order by slot) - 1 as k from fold where pick is not null),
r as (select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) - 1 as rank from documents),
b as (select doc_id, r.source, rank, rank // {BLOCK_ROWS} as block, t.a, t.i, rank // {BLOCK_ROWS} // t.a as period, rank // {BLOCK_ROWS} % t.a as k from r join t on r.source is not distinct from t.source),
c as (select b.*, (select max(start) from phase where start <= b.period) as start from b)
select doc_id, source, block, base + (period - c.start) * len + c.k * len // a as release, base + (period - c.start) * len + ((c.k + 1) * len + a - 1) // a as deadline,
  base + (period - c.start) * len + spot as slot, (base + (period - c.start) * len + spot) * {BLOCK_ROWS} + rank % {BLOCK_ROWS} as position
from c join phase p on c.start = p.start join plan l on l.start = c.start and l.i = c.i and l.k = c.k
"""
