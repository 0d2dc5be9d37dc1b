import collections
import math

import pyarrow as pa

from tessera.llm import quality as Q
from tests.llm import brute


def test_counts(rows):
    texts = [r[1] for r in rows] + ["\x0b\x0c a b\r\n a b\n\n", "a a a a a", "# * $ % & | < >"]
    got = list(zip(*[c.to_pylist() for c in Q.measure(pa.array(texts, pa.string()))], strict=True))
    assert got == [brute.quality(t) for t in texts]


def test_verdicts(spark, odd, rows):
    got = Q.judged(odd, ["doc_id", "text"]).select("row.text", "found.*", "verdict.*").collect()
    assert len(got) == len(rows)
    for r in got:
        n, _, _, _, _, repeat = brute.quality(r.text)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.passed)
    left = Q.quality_filtered(odd)
    assert left.columns == odd.columns and left.count() == sum(r.passed for r in got)
    assert Q.quality_filtered(odd.limit(0)).count() == 0


def test_thresholds_adapt_to_the_group(spark):
    plain = "word " * 3 + " ".join(f"w{i}" for i in range(80))
    rows = [(i, plain.replace("w7", f"x{i}"), "en", "clean") for i in range(30)]
    rows += [(100 + i, " ".join(f"w{k}#" for k in range(80)) + f" {i}", "en", "symbols") for i in range(30)]
    rows += [(200, " ".join(f"w{k}#" for k in range(80)), "en", "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in Q.quality_filtered(docs).collect()} == {r[0] for r in rows} - {200}


def fences(ratios):
    """Low and high of each ratio of a group, from its sorted values, to the middle of their bins."""
    step = math.log((1 + Q.ACCURACY) / (1 - Q.ACCURACY))
    out = {}
    for k, least in Q.SPREAD.items():
        x = sorted(r[k] for r in ratios)
        q1, q3 = (math.exp(math.ceil(math.log(v) / step) * step) * (1 - Q.ACCURACY) if v else 0.0 for v in (x[int(q * (len(x) - 1))] for q in (0.25, 0.75)))
        for exact, found in ((x[int(0.25 * (len(x) - 1))], q1), (x[int(0.75 * (len(x) - 1))], q3)):
            assert abs(exact - found) <= 1.01 * Q.ACCURACY * exact
        spread = max(q3 - q1, least) * Q.REACH
        out[k] = (q1 - spread, q3 + spread)
    return out


def test_verdicts_are_those_of_a_plain_version_in_any_layout(spark, odd, rows):
    def ratio(text):
        n, chars, symbols, lines, dup, repeat = brute.quality(text)
        return {"symbol_ratio": symbols / max(chars, 1), "dup_line_ratio": dup / max(lines, 1), "repeat_ratio": repeat / max(n, 1), "word_length": chars / max(n, 1)}

    big = [*rows, *[(900 + i, " ".join(f"w{(i * k) % 67}" + "#" * (i % 9) * (k % 7 == 0) for k in range(70)), "en", "a", 1) for i in range(200)]]
    groups = collections.defaultdict(list)
    for r in big:
        n, *_, repeat = brute.quality(r[1])
        if not (n < 50 or 100 * repeat > 50 * n):
            groups[r[2], r[3]].append(ratio(r[1]))
    limits = {k: fences(v) for k, v in groups.items()}
    want = collections.Counter()
    for r in big:
        n, *_, repeat = brute.quality(r[1])
        failed = n < 50 or 100 * repeat > 50 * n
        x = ratio(r[1])
        fits = not failed and all(x[k] <= hi and (k != "word_length" or x[k] >= lo) for k, (lo, hi) in limits[r[2], r[3]].items())
        want[r[0], r[1], failed, fits] += 1
    docs = spark.createDataFrame(big, "doc_id long, text string, lang string, source string, n_chars long")
    seen = set()
    for parts in (1, 7):
        layout = docs.repartition(parts)
        got = Q.judged(layout, ["doc_id", "text"]).select("row.*", "verdict.*").collect()
        assert collections.Counter(map(tuple, got)) == want
        seen.add(tuple(sorted(map(repr, Q.thresholds(layout).collect()))))
    assert len(seen) == 1
