"""Positions and numbers inside segments from one layout."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions.rng import h
from tessera.operators import ids as D
from tessera.operators import sampling as R
from tessera.sources import sinks as K


def test_segment_numbers(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", None])) for i in rnd.sample(range(10000), 500)]
    df = spark.createDataFrame(rows, "id long, seg string").repartition(3)
    want, seen = {}, {}
    for pos, (i, s) in enumerate(sorted(rows)):
        want[i] = (s, pos, seen.setdefault(s, 0))
        seen[s] += 1
    assert {r.id: (r.seg, r.position, r["index"]) for r in D.segment_numbers(df, "seg", ["id"]).collect()} == want
    assert D.segment_numbers(df.limit(0), "seg", ["id"]).count() == 0


def test_csr_offsets(spark):
    df = spark.createDataFrame([(k,) for k in range(40) for _ in range(k % 5 + 1)], "k long").repartition(3)
    start = 0
    for n, r in enumerate(D.csr_offsets(df, "k").orderBy("k").collect()):
        assert (r["index"], r.k, r["start"], r["end"], r["size"]) == (n, n, start, start + n % 5 + 1, n % 5 + 1)
        start = r["end"]
    assert start == df.count()


def test_category_files(spark):
    path = tempfile.mkdtemp(prefix="tessera-cat-")
    rows = spark.createDataFrame([(3, "Small", "2*3"), (1, "Large", "5*3"), (2, "Small", "2*2")], "id long, category string, base_size string")
    K.write_categories(rows, path, ["id"])
    assert sorted((r.category, r["index"], r.position) for r in spark.read.parquet(f"{path}/indices").collect()) == \
        [("Large", 0, 0), ("Small", 0, 1), ("Small", 1, 2)]
    assert {r.category: (r.start, r.end) for r in spark.read.parquet(f"{path}/offsets").collect()} == {"Large": (0, 1), "Small": (1, 3), None: (0, 3)}


@pytest.mark.parametrize("frac", [0.0, 0.37, 0.8, 1.0])
def test_split_cuts_the_seeded_order_without_a_sort(spark, frac, monkeypatch):
    """Copies and null keys: as many rows as asked, in the order of (hash, key), nothing checkpointed."""
    rows = [(None if i % 50 == 0 else f"k{i % 400}", i) for i in range(1000)] + [("many", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    out = R.train_test_split(df, frac, 7, "k")
    got = [(r.k, r.v, r.split) for r in out.collect()]
    assert sorted(g[1] for g in got) == sorted(r[1] for r in rows) and sum(s == "train" for *_, s in got) == math.floor(1500 * frac)
    order = {(r.k): (r.h, r.k or "") for r in df.select("k", h(7, F.col("k")).alias("h")).distinct().collect()}
    train, test = ([order[k] for k, _, s in got if s == side] for side in ("train", "test"))
    assert not train or not test or max(train) <= min(test)
    assert out.columns == ["k", "v", "split"]
    monkeypatch.setattr(R, "dense_id", None)  # not even called for keys that occur once
    one = R.train_test_split(df.filter("k <> 'many'").dropDuplicates(["k"]), frac, 7, "k")
    assert one.filter("split = 'train'").count() == math.floor(one.count() * frac)
