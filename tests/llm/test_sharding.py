import collections
import hashlib
import heapq
import random
import zlib

from tessera.llm import sharding as S


def one_by_one(sizes, shards):
    """Shards of the jobs of each size, every job taken from the heap by itself."""
    heap, out = [(0, s) for s in range(shards)], {}
    for size, jobs in sorted(sizes, reverse=True):
        for i in range(jobs):
            load, s = heapq.heappop(heap)
            out[size, i] = s
            heapq.heappush(heap, (load + size, s))
    return out


def test_runs_are_those_of_a_plain_heap():
    rnd = random.Random(8)
    for _ in range(300):
        shards = rnd.choice([1, 2, 3, 16])
        sizes = [(n, rnd.choice([1, 2, rnd.randint(1, 60)])) for n in rnd.sample(range(1, rnd.choice([12, 400, 90000])), rnd.randint(1, 10))]
        got = {}
        for size, runs in S.longest_first(sizes, shards):
            assert len(runs) <= shards
            for i in range(dict(sizes)[size]):
                first, order = [r for r in runs if r[0] <= i][-1]
                got[size, i] = order[(i - first) % len(order)]
        assert got == one_by_one(sizes, shards)


def test_groups_go_as_through_a_plain_heap(odd, rows):
    texts = collections.Counter((r[1] or "").encode() for r in rows)
    groups = collections.defaultdict(list)
    for t, n in texts.items():
        groups[n * (len(t) + 1)].append(hashlib.sha256(t).hexdigest())
    want = one_by_one([(k, len(v)) for k, v in groups.items()], 5)
    of = {d: want[k, i] for k, v in groups.items() for i, d in enumerate(sorted(v))}
    crc = {zlib.crc32(t): of[hashlib.sha256(t).hexdigest()] for t in texts}
    assert {r.text_crc32: r.shard for r in S.sharded(odd, 5).collect()} == crc


def test_sharded(odd, rows):
    for shards in (4, 40):
        got = S.sharded(odd, shards).collect()
        assert len(got) == len(rows)
        sizes = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
        assert sorted((r["size"], r.text_crc32) for r in got) == sizes
        slots, texts = collections.defaultdict(list), collections.defaultdict(set)
        for r in got:
            slots[r.shard].append(r.slot)
            texts[r.text_crc32].add(r.shard)
            assert r.law == "bytes" and r.grown_shard is None
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert all(len(v) == 1 for v in texts.values())
    assert S.sharded(odd.limit(0)).count() == 0


def test_loads_are_close(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 97 + 1)) for i in range(4000)] + [(5000 + i, "hot") for i in range(2000)], "doc_id long, text string")
    load = collections.Counter()
    for r in S.sharded(docs, 4).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values())
