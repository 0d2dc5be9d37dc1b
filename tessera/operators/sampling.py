"""Seeded sampling, shuffling, splitting and routing.

Every draw is ``h(seed, key...)`` (R0), so a row's fate does not depend on
partitioning or on the order rows arrive in. Nothing here collects a group:
per-group picks are aggregates (min_by) and per-group ranks are windows whose
partitions are the (bounded) example lists of one puzzle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rng import h
from tessera.operators.ids import dense_id


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in ([keys] if isinstance(keys, (str, Column)) else keys)]


def sample_exact(df: DataFrame, n: int, seed: int, key) -> DataFrame:
    """Exactly ``min(n, count)`` rows without replacement.

    Sort by (hash, key) and take n: Spark plans this as TakeOrderedAndProject,
    a per-task top-n followed by a merge of n rows per task, so no full sort.
    """
    keys = _cols(key)
    return df.withColumn("_h", h(seed, *keys)).orderBy("_h", *keys).limit(n).drop("_h")


def shuffle_order(df: DataFrame, seed: int, key, start: int = 0, name: str = "order", ties=None) -> DataFrame:
    """R2: a seeded permutation as a dense position column (D1 on (hash, key)).

    ``ties``: columns that tell unequal rows of one key apart. Rows then have one
    order whenever they are numbered, so no layout is sampled or kept: they are
    dealt by the upper 12 bits of their hash and numbered behind the rows counted
    in the numbers before. ``df`` is read twice, for the count without its other columns.
    """
    keys = _cols(key)
    tmp = df.withColumn("_h", h(seed, *keys))
    if ties is not None:
        upper = F.shiftright("_h", 20)
        counts = tmp.groupBy(upper.alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
        starts = counts.select("_u", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
        inside = Window.partitionBy("_u").orderBy("_h", *keys, *_cols(ties))
        numbered = tmp.withColumn("_u", upper).withColumn("_i", F.row_number().over(inside) - 1)
        place = (F.col("_s") + F.col("_i") + F.lit(start)).cast("long")
        return numbered.join(F.broadcast(starts), "_u").select(*df.columns, place.alias(name))
    return dense_id(tmp, ["_h", *[k for k in keys]], name=name, start=start).drop("_h")


def route_by_fraction(df: DataFrame, rules: list[tuple[float, str]], seed: int, key,
                      default: str | None = None, name: str = "dest") -> DataFrame:
    """position/total of the shuffled rows; the first rule whose bound exceeds it wins."""
    ordered = shuffle_order(df, seed, key, name="_pos")
    total = ordered.agg(F.count("*").alias("_n"))
    o = ordered.crossJoin(F.broadcast(total))  # one-row side
    frac = F.col("_pos") / F.col("_n")
    expr = None
    for bound, dest in rules:
        expr = F.when(frac < bound, F.lit(dest)) if expr is None else expr.when(frac < bound, F.lit(dest))
    expr = expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)
    return o.withColumn(name, expr).drop("_pos", "_n")


def route_by_role(df: DataFrame, dest_map: dict[str, tuple[str, str]], role_col: str = "role") -> DataFrame:
    """An example's role maps to a (split, set) destination."""
    split = None
    set_name = None
    for role, (sp, st) in dest_map.items():
        cond = F.col(role_col) == role
        split = F.when(cond, F.lit(sp)) if split is None else split.when(cond, F.lit(sp))
        set_name = F.when(cond, F.lit(st)) if set_name is None else set_name.when(cond, F.lit(st))
    return df.withColumn("split", split).withColumn("set_name", set_name)


def _first_rows(df: DataFrame, seed: int, keys: list[Column], how_many) -> DataFrame:
    """``df`` with ``_first``: the first ``how_many(rows)`` rows of the seeded order of (hash, key).

    The order is cut at one place, so nothing is sorted or shuffled: rows are
    counted by the upper half of their hash (65,536 numbers at most), and in the
    number where the cut lies, one row in 65,536, by key. Other rows are told by
    their hash. Copies of a key on both sides of the cut are numbered.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select("*", h(seed, *keys).alias("_h"), *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    upper = F.shiftright("_h", 16)
    counts = sorted(rows.groupBy(upper.alias("at")).count().collect())
    left = how_many(sum(r["count"] for r in counts))
    for at, size in counts:
        if left < size:
            break
        left -= size
    else:
        return df.withColumn("_first", F.lit(True))
    place = F.struct("_h", *names)
    inside = rows.filter(upper == at).groupBy("_h", *names).count().orderBy("_h", *names).collect()
    for *cut, size in inside:
        if left < size:
            break
        left -= size
    border = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(["_h", *names], cut, strict=True)])
    told = rows.withColumn("_first", place < border)
    if left > 0:  # copies of one key
        copies = shuffle_order(rows.filter(place.eqNullSafe(border)), seed, keys, name="_pos")
        told = told.filter(~place.eqNullSafe(border)).unionByName(copies.withColumn("_first", F.col("_pos") < left).drop("_pos"), allowMissingColumns=True)
    return told.drop("_h", *names)


def train_test_split(df: DataFrame, frac: float, seed: int, key, group=None) -> DataFrame:
    """Exact split, n_train = floor(frac * n); the rest is test.

    With ``group`` the unit of the split is the group (a base puzzle and its
    expansions stay on one side); n_train = floor(frac * groups).
    """
    unit = df.select(*_cols(group)).distinct() if group is not None else df
    ukeys = _cols(group if group is not None else key)
    o = _first_rows(unit, seed, ukeys, lambda n: math.floor(n * frac)).withColumn(
        "split", F.when(F.col("_first"), F.lit("train")).otherwise(F.lit("test"))).drop("_first")
    if group is not None:
        o = df.join(o.select(*[c for c in ([group] if isinstance(group, str) else group)], "split"),
                    [group] if isinstance(group, str) else list(group))
    return o


def pick_one_per_group(df: DataFrame, group, seed: int, tiebreak, value=None, name: str = "picked") -> DataFrame:
    """One seeded member per group, as an aggregate (no window, no collect).

    Returns one row per group with the picked ``value`` (default: the tiebreak key).
    """
    gcols, tcols = _cols(group), _cols(tiebreak)
    val = F.col(value) if isinstance(value, str) else (value if value is not None else tcols[0])
    hk = h(seed, *gcols, *tcols)
    order_key = F.struct(hk.alias("k"), *[c.alias(f"t{i}") for i, c in enumerate(tcols)])
    return df.groupBy(*gcols).agg(F.min_by(val, order_key).alias(name))


def pick_k(df: DataFrame, group, k: int, seed: int, tiebreak) -> DataFrame:
    """K members of each group without replacement (seeded)."""
    gcols, tcols = _cols(group), _cols(tiebreak)
    w = Window.partitionBy(*gcols).orderBy(h(seed, *gcols, *tcols), *tcols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def mark_exempt(df: DataFrame, group, seed: int, tiebreak, name: str = "exempt") -> DataFrame:
    """Flag one seeded example per puzzle (exempt from translation)."""
    gcols = group if isinstance(group, list) else [group]
    t = tiebreak if isinstance(tiebreak, str) else tiebreak
    picked = pick_one_per_group(df, gcols, seed, t, value=t, name="_exempt_key")
    out = df.join(picked, gcols)
    return out.withColumn(name, F.col(t) == F.col("_exempt_key")).drop("_exempt_key")
