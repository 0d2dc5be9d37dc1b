"""Dense ids, identifier dictionaries, CSR offsets, interval lookup, metadata.

Dense numbering never uses an unpartitioned window over the data: rows are
range-partitioned and sorted, the partition layout is checkpointed to the
shared folder (so a retried task sees the same rows), each partition is
counted, and the per-partition start offsets (one row per partition, a proven
size bound) are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

_LOW33 = (1 << 33) - 1


def _order_cols(order) -> list[Column]:
    out = []
    for o in ([order] if isinstance(order, (str, Column)) else order):
        out.append(F.col(o) if isinstance(o, str) else o)
    return out


def _layout(df: DataFrame, order, num_partitions: int | None) -> DataFrame:
    oc = _order_cols(order)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range bounds are sampled: counting and numbering must see one and the same layout
    ranged = materialise(df.repartitionByRange(n, *oc).sortWithinPartitions(*oc))
    return ranged.withColumn("_t_pid", F.spark_partition_id()) \
                 .withColumn("_t_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)))


def _partition_offsets(laid: DataFrame, weight: Column | None = None) -> DataFrame:
    w = F.count("*") if weight is None else F.sum(weight)
    counts = laid.groupBy("_t_pid").agg(w.alias("_t_cnt"))
    before = Window.orderBy("_t_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the window runs over num_partitions rows only
    return counts.select("_t_pid", F.coalesce(F.sum("_t_cnt").over(before), F.lit(0)).alias("_t_off"))


def dense_id(df: DataFrame, order, name: str = "id", start: int = 0,
             num_partitions: int | None = None) -> DataFrame:
    """0-based (plus ``start``) position of each row in ``order``.

    ``order`` should be a total order (add a tiebreak key). The lineage is cut
    with a reliable checkpoint before numbering.
    """
    laid = _layout(df, order, num_partitions)
    offs = _partition_offsets(laid)
    out = laid.join(F.broadcast(offs), "_t_pid")
    return out.withColumn(name, (F.col("_t_off") + F.col("_t_pos") + F.lit(start)).cast("long")) \
              .drop("_t_pid", "_t_pos", "_t_off")


def prefix_sum(df: DataFrame, value: str, order, name: str = "prefix",
               inclusive: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Running total of ``value`` in ``order`` (exclusive by default), distributed.

    Partition totals are offsets; inside a partition a window runs on the
    partition id, which is balanced because the layout is range-partitioned.
    """
    laid = _layout(df, order, num_partitions)
    offs = _partition_offsets(laid, F.col(value))
    frame = (Window.partitionBy("_t_pid").orderBy("_t_pos")
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = laid.withColumn("_t_loc", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    return local.join(F.broadcast(offs), "_t_pid") \
        .withColumn(name, (F.col("_t_off") + F.col("_t_loc")).cast("long")).drop("_t_pid", "_t_pos", "_t_off", "_t_loc")


def identifier_map(df: DataFrame, name_col: str, order, start: int = 1,
                   blank_name: str = "<blank>") -> DataFrame:
    """Dense id per distinct name in first-appearance ``order``; 0 is the blank id."""
    oc = _order_cols(order)
    first = df.groupBy(name_col).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(oc)])).alias("_first"))
    ids = dense_id(first, [F.col("_first"), F.col(name_col)], name="puzzle_identifier", start=start)
    return ids.select(F.col("puzzle_identifier").cast("int"), F.col(name_col).alias("puzzle_name"))


def csr_offsets(df: DataFrame, key, order=None) -> DataFrame:
    """D3: (index, key, start, end) per key in ``order``; starts are a prefix sum from 0.

    The CSR array of the reference is ``[start_0, ..., start_{n-1}, end_{n-1}]``.
    Numbers and starts come from one layout of the keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    laid = _layout(df.groupBy(*keys).agg(F.count("*").alias("size")), order or keys, None)
    counts = laid.groupBy("_t_pid").agg(F.count("*").alias("_t_cnt"), F.sum("size").alias("_t_sum"))
    before = Window.orderBy("_t_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, as in _partition_offsets
    offs = counts.select("_t_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("_t_cnt", "_t_off"), ("_t_sum", "_t_start"))])
    frame = Window.partitionBy("_t_pid").orderBy("_t_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumn("_t_loc", F.coalesce(F.sum("size").over(frame), F.lit(0)))
    start = (F.col("_t_start") + F.col("_t_loc")).cast("long")
    return local.join(F.broadcast(offs), "_t_pid").select(
        *keys, "size", start.alias("start"), (F.col("_t_off") + F.col("_t_pos")).cast("long").alias("index"), (start + F.col("size")).alias("end"))


def segment_numbers(df: DataFrame, segment: str, order, position: str = "position", name: str = "index") -> DataFrame:
    """D1 + D3 per segment: ``position`` of each row in ``order`` and its ``index`` among the rows of its segment.

    Both come from one layout in ``order``: a row's index is the rows of its
    segment in the partitions before (a table of partitions x segments; for
    segments of a small, fixed number, such as categories) and before it in its own.
    """
    laid = _layout(df, order, None)
    counts = laid.groupBy("_t_pid", segment).agg(F.count("*").alias("_t_cnt"))
    before = Window.partitionBy(segment).orderBy("_t_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_t_pid", F.col(segment).alias("_t_seg"), F.coalesce(F.sum("_t_cnt").over(before), F.lit(0)).alias("_t_start"))
    inside = F.row_number().over(Window.partitionBy("_t_pid", segment).orderBy("_t_pos")) - 1
    out = laid.withColumn("_t_in", inside).join(F.broadcast(_partition_offsets(laid)), "_t_pid").alias("r")
    here = (F.col("r._t_pid") == F.col("s._t_pid")) & F.col(f"r.{segment}").eqNullSafe(F.col("s._t_seg"))
    out = out.join(F.broadcast(starts).alias("s"), here)
    return out.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_t_off") + F.col("_t_pos")).cast("long").alias(position),
                      (F.col("_t_start") + F.col("_t_in")).cast("long").alias(name))


def lookup_interval(points: DataFrame, pos_col: str, intervals: DataFrame,
                    start_col: str = "start", end_col: str = "end", bucket: int = 4096) -> DataFrame:
    """Attach the interval [start, end) that holds each point (range join).

    Intervals are exploded into the fixed-width buckets they overlap; the join
    is an equi-join on the bucket plus the range filter, so a long interval
    costs one row per bucket it spans and no task sees more than a bucket.
    """
    b = F.lit(bucket)
    iv = intervals.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col(start_col) / b), F.floor((F.greatest(F.col(end_col), F.col(start_col) + 1) - 1) / b))))
    pt = points.withColumn("_b", F.floor(F.col(pos_col) / b))
    j = pt.join(iv, "_b").filter((F.col(pos_col) >= F.col(start_col)) & (F.col(pos_col) < F.col(end_col)))
    return j.drop("_b")


def build_metadata(df: DataFrame, spec: dict, split_col: str = "split") -> DataFrame:
    """Per split: groups, puzzles, mean examples per puzzle, sets, plus fixed spec fields.

    Two-level aggregation (examples -> puzzles -> split) instead of several
    distinct counts over the example table.
    """
    per_puzzle = df.groupBy(split_col, "set_name", "group_id", "puzzle_id").agg(F.count("*").alias("n_ex"))
    per_group = per_puzzle.groupBy(split_col, "set_name", "group_id").agg(
        F.count("*").alias("n_puz"), F.sum("n_ex").alias("n_ex"))
    meta = per_group.groupBy(split_col).agg(
        F.count("*").alias("total_groups"),
        F.sum("n_puz").cast("long").alias("total_puzzles"),
        (F.sum("n_ex") / F.sum("n_puz")).alias("mean_puzzle_examples"),
        F.array_sort(F.collect_set("set_name")).alias("sets"))
    for k, v in spec.items():
        meta = meta.withColumn(k, F.lit(v))
    return meta


def merge_metadata(metas: DataFrame, check_fields=("pad_id", "ignore_label_id", "blank_identifier_id",
                                                     "vocab_size", "seq_len", "sets")) -> DataFrame:
    """D6 (+V5): fields that must agree across paths, sums, puzzle-weighted mean.

    ``consistent`` is false where a field differs between paths, also where only
    some have it; sets agree in any order, and those of all paths are returned.
    ``expect.metadata_rules`` stops a write on it.
    """
    value = {c: F.array_sort(c) if c == "sets" else F.col(c) for c in check_fields}
    aggs = [F.count_distinct(F.struct(value[c])).alias(f"_nd_{c}") for c in check_fields]  # a struct: null is a value too
    aggs += [F.first(c).alias(c) for c in check_fields if c != "sets"]
    aggs += [F.sum("total_groups").alias("total_groups"),
             F.sum("total_puzzles").alias("total_puzzles"),
             (F.sum(F.col("mean_puzzle_examples") * F.col("total_puzzles")) / F.sum("total_puzzles")).alias("mean_puzzle_examples"),
             F.sum("num_puzzle_identifiers").alias("num_puzzle_identifiers"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets")]
    m = metas.groupBy("split").agg(*aggs)
    ok = None
    for c in check_fields:
        cond = F.col(f"_nd_{c}") <= 1
        ok = cond if ok is None else ok & cond
    return m.withColumn("consistent", ok).drop(*[f"_nd_{c}" for c in check_fields])


def plan_steps(meta: DataFrame, epochs: int, global_batch: int) -> DataFrame:
    """int(epochs * total_groups * mean_puzzle_examples / global_batch)."""
    return meta.withColumn("total_steps", F.floor(
        F.lit(epochs) * F.col("total_groups") * F.col("mean_puzzle_examples") / F.lit(global_batch)).cast("long"))


def corpus(df: DataFrame, cols: list[str], distinct: bool = True, weighted: tuple[str, ...] = ()) -> DataFrame:
    """Values of several text columns as one (column, text) corpus, in one pass over ``df``.

    ``distinct`` dedupes within each column, not across columns. The ``weighted``
    columns among ``cols`` are deduped too, but keep their rows as a ``weight``
    (1 in the other columns).
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in cols]))
    out = df.select(each.alias("_c")).select("_c.column", "_c.text")
    if not weighted:
        return out.distinct() if distinct else out
    weight = F.when(F.col("column").isin(*weighted), F.col("_n")).otherwise(F.lit(1))
    return out.groupBy("column", "text").agg(F.count(F.lit(1)).alias("_n")).select("column", "text", weight.alias("weight"))
