import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_dedup as N
from tessera.llm.components import components
from tests.llm import brute


def test_matches_brute_force(odd, rows):
    for width, percent in ((3, 85), (5, 80)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(odd, width, percent).collect()), key=repr)
        want = brute.near([(r[0], r[1]) for r in rows], width, percent)
        assert got == sorted(((r[0], *w, r[0] == w[1]) for r, w in zip(rows, want, strict=True)), key=repr)


def test_chains_and_groups_of_edits(spark):
    """A chain of small edits is one component, also where its ends are unlike; groups of edits hide links from the pivot."""
    rnd = random.Random(3)
    text = [f"w{rnd.randint(0, 500)}" for _ in range(150)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(text)))
        for _ in range(2):
            text[rnd.randrange(150)] = f"v{rnd.randint(0, 10**6)}"
    base = [f"u{i}" for i in range(140)]
    for k in range(80):
        own = list(base)
        for _ in range(rnd.randint(1, 9)):
            own[rnd.randrange(140)] = f"t{rnd.randint(0, 10**6)}"
        rows.append((100 + k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {r[0]: w[1] for r, w in zip(rows, brute.near(rows, 3, 85), strict=True)}


def test_truncated_copies_that_sizes_part_from_the_pivot(spark):
    """The shortest copy is linked only with copies that are near a pivot it was never compared with."""
    rows = []
    for g in range(4):
        for n in (810, *range(950, 1001)):
            rows.append((1000 * g + 1000 - n, " ".join(f"g{g}w{i}" for i in range(n + 2))))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {r[0]: w[1] for r, w in zip(rows, brute.near(rows, 3, 85), strict=True)}


def test_deduplicated_keeps_one_of_each(odd, rows):
    left = N.deduplicated(odd)
    assert left.columns == odd.columns
    want = brute.near([(r[0], r[1]) for r in rows], 3, 85)
    kept = {(r[0], r[1]) for r, w in zip(rows, want, strict=True) if r[0] == w[1]}
    assert sorted(((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()), key=repr) == sorted(kept, key=repr)
    assert N.deduplicated(odd.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (100, 100)] + [(300, 301 + i) for i in range(40)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    groups = {frozenset(r.v) for r in got.groupBy("root").agg(F.collect_set("v").alias("v")).collect()}
    assert groups == {frozenset(range(51)), frozenset([100, 200]), frozenset(range(300, 341))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_xor_count_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.sort(np.concatenate([a[:919], rng.integers(0, 1 << 62, 81).astype(np.uint64)]))  # similarity 0.85
    c = np.sort(np.concatenate([a[:700], rng.integers(0, 1 << 62, 300).astype(np.uint64)]))
    s = N.odd_sketch(N.samples(np.concatenate([a, b, c]), np.array([0, 1000, 2000, 3000]), N.SAMPLES), N.BITS)
    count = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    limit = N.xor_limit(.85, N.SAMPLES, N.BITS)
    assert count(s[0], s[1]) <= limit < count(s[0], s[2])


def linked_by_bitsets(rows, width, percent):
    """Component ids as by ``brute.near``, with a bit for each shingle."""
    number, sets = {}, []
    for _, t in rows:
        sets.append(sum(1 << number.setdefault(x, len(number)) for x in brute.shingles(t, width)))
    size, group = [x.bit_count() for x in sets], list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = (sets[a] & sets[b]).bit_count()
            if 100 * both >= percent * (size[a] + size[b] - both):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {rows[k][0]: rows[top(k)][0] for k in range(len(rows))}


def test_few_pairs_of_a_large_group_are_tested(spark, monkeypatch):
    """1,500 copies with edits of their own: links as by brute force, and a few tested pairs a copy outside the stars."""
    rnd = random.Random(8)
    base = [f"u{i}" for i in range(120)]
    rows, tested = [], []
    plain = N.stored

    def counted(df, name, *rest, **more):
        out = plain(df, name, *rest, **more)
        if name == "hidden-pairs":
            tested.append(out.count())
        return out

    monkeypatch.setattr(N, "stored", counted)
    for k in range(1500):
        own = list(base)
        for _ in range(rnd.randint(1, 4)):
            own[rnd.randrange(120)] = f"t{rnd.randint(0, 10**6)}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked_by_bitsets(rows, 3, 85)
    assert sum(tested) <= 4 * len(rows), tested


def test_sketches_are_made_a_few_rows_at_a_time():
    """A worker held the bit counts of all rows of a chunk at once, 16 KB a row."""
    import tracemalloc
    minima = np.random.default_rng(3).integers(0, 1 << 63, (3000, N.SAMPLES), dtype=np.uint64)
    tracemalloc.start()
    got = N.odd_sketch(minima, N.BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and got.shape == (3000, N.BITS // 64) and N.odd_sketch(minima[:0], N.BITS).shape == (0, N.BITS // 64)
    assert (got[-1] == N.odd_sketch(minima[-1:], N.BITS)[0]).all()
