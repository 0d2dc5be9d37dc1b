import collections
from fractions import Fraction

from pyspark.sql import functions as F

from tessera.llm import mixing as M


def slots_of(shares):
    """Earliest deadline first over one period, in plain Python."""
    period, done, out = sum(shares), [0] * len(shares), []
    for t in range(period):
        free = [(-(-(done[i] + 1) * period // a), i) for i, a in enumerate(shares) if done[i] < a and done[i] * period // a <= t]
        i = min(free)[1]
        done[i] += 1
        out.append(i)
    return out


def test_schedule_is_edf_and_stays_within_one_block(spark):
    for shares in ([1], [3, 1], [5, 3, 2, 2], [36, 1, 1, 1, 2, 7]):
        row = spark.createDataFrame([([(f"s{i}", a) for i, a in enumerate(shares)],)], "active array<struct<source: string, a: int>>")
        got = row.select(M.earliest_deadline_first(F.col("active"), F.lit(sum(shares))).alias("p")).first().p
        assert got == slots_of(shares)
        done = [0] * len(shares)
        for t, i in enumerate(got, 1):
            done[i] += 1
            assert all(abs(d - Fraction(a * t, sum(shares))) < 1 for d, a in zip(done, shares, strict=True))


def test_mixture(spark):
    rows = [(i, "t", "hot") for i in range(900)] + [(1000 + i, "t", "b") for i in range(330)] + [(2000 + i, "t", None) for i in range(100)] + [(3000, "t", "tiny"), (3000, "t", "tiny"), (None, None, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mixing_slots(docs, {"hot": 3.0, "b": 2.0, "tiny": 0.1}, period=10, block_rows=4).orderBy("position").collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    # until the first source runs out, each is less than a block from its share of the slots
    blocks = sorted({(r.slot, r.source) for r in got}, key=lambda x: x[0])
    assert [s for s, _ in blocks[:10]] == list(range(10))
    count = collections.Counter(s for _, s in blocks[:10])
    assert count["hot"] == 6 and count["b"] == 4 or sum(count.values()) == 10


def test_mixed_keeps_rows_and_order(odd, rows):
    left = M.mixed(odd)
    assert left.columns == odd.columns and left.count() == len(rows)
    place = collections.defaultdict(list)
    for r in M.mixing_slots(odd).collect():
        place[r.doc_id].append(r.position)
    order = [place[r.doc_id] for r in left.select("doc_id").collect()]
    assert [min(p) for p in order if len(p) == 1] == sorted(min(p) for p in order if len(p) == 1)
    assert M.mixing_slots(odd.limit(0)).count() == 0
