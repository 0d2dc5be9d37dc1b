import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import importance as I
from tests.llm import brute

ITEMS = [(1, "The river stone ran home"), (2, None), (3, ""), (4, "quick fox über maße 1984 the RIVER stone")]


def features(text):
    w = brute.ALNUM.findall(brute.lower(text))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain(rows, items):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text) row."""
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    found = [features(t) for _, t in rows]
    s = Counter(bucket(x) for _, f in found for x in f)
    t = Counter(bucket(x) for _, i in items for x in features(i)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for k, ((i, text), (n, f)) in enumerate(zip(rows, found, strict=True)):
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([k, i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None])
    able = sorted((r for r in out if r[2] >= 20), key=lambda r: (-r[5], r[1] is None, r[1] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[6] = k + 1
    return [(r[1], *r[3:]) for r in out]


@pytest.mark.parametrize("head", [1 << 15, 16])
def test_matches_plain_version(spark, odd, rows, head):
    target = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = I.resampled(odd, target, head=head).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = plain([(r[0], r[1]) for r in rows], ITEMS)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(r.rank is not None for r in got) + 1))


def test_ties_and_quota(spark):
    """Equal ids have equal noise, so copies under one id tie; the quota cuts inside a tie."""
    rows = [(i // 4, " ".join(f"w{k}" for k in range(30))) for i in range(41)] + [(None, "w1 " * 25), (99, "short")]
    got = I.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == sorted(plain(rows, ITEMS), key=repr)


def test_empty_tables(spark, odd, rows):
    target = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert I.resampled(odd.limit(0), target).count() == 0
    got = I.resampled(odd, target.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain([(r[0], r[1]) for r in rows], []), key=repr)


def test_crc():
    words = [b"", b"a", b"word", b"x" * 63, b"y" * 64, b"z" * 300, "\u00e9\u00df".encode()]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    begun = np.array([zlib.crc32(b"head")] * len(words), np.uint32)
    assert I.crc_extended(begun, data, start, end).tolist() == [zlib.crc32(b"head" + w) for w in words]
    assert I.crc_blank(begun)[0] == zlib.crc32(b"head ")


def test_frequent_summaries_add_up():
    """A key over the share that the size allows is never lost, however the data are cut."""
    rng = np.random.default_rng(1)
    keys = np.concatenate([np.full(3000, 7), np.full(2000, 9), rng.integers(100, 10**9, 20000)]).astype(np.uint64)
    rng.shuffle(keys)
    total = I.Frequent(20)
    for part in np.array_split(keys, 7):
        own = I.Frequent(20)
        for chunk in np.array_split(part, 5):
            k, n = np.unique(chunk, return_counts=True)
            own.add(k, n, k.astype(np.uint32))
        own.trim()
        assert len(own.keys) <= 20
        total.add(own.keys, own.counts, own.values)
    assert {7, 9} <= set(total.keys.tolist())
    assert all(v == k for k, v in zip(total.keys.tolist(), total.values.tolist(), strict=True) if k < 100)
