import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tests.llm import brute


def test_judge_matches_brute_force(monkeypatch):
    rnd = random.Random(1)
    for _ in range(60):
        alphabet = ["a", "B", "c1", "é", "zz", "Q"][:rnd.randint(2, 6)]

        def text(n):
            return None if rnd.random() < .05 else rnd.choice([" ", ", ", "\n"]).join(rnd.choice(alphabet) for _ in range(rnd.randint(0, n)))  # noqa: B023
        docs = [text(60) for _ in range(15)]
        items = [(rnd.choice([None, 1, 2, 10, 33]), text(16)) for _ in range(rnd.randint(0, 6))]
        for _, t in items:
            if t and rnd.random() < .7:
                docs[rnd.randrange(15)] = f"{text(9) or ''} {t} x {text(5) or ''}"
        monkeypatch.setattr(D, "SHARD_BYTES", rnd.choice([50, 300, 1 << 20]))
        blocks = [q for q in (D.prepare(items[:3], 4), D.prepare(items[3:], 4)) if q]
        got = D.judge(pa.array(docs, pa.string()), blocks)
        assert list(zip(got["n_words"], got["n_hit"], got["n_items"], got["items_sha256"], strict=True)) == brute.contamination(docs, items, 4)


def test_matches_are_longest_and_verbatim():
    q = D.prepare([(7, "one two three four five six")], 3)
    got = D.judge(pa.array(["zero ONE two, three four nine", "two three four five six one two"]), [q])
    assert got["matches"][0] == [{"item_id": 7, "item_word": 0, "doc_word": 1, "n_words": 4}]
    assert got["matches"][1] == [{"item_id": 7, "item_word": 1, "doc_word": 0, "n_words": 5}]
    assert got["longest_match"] == [4, 5]


def test_spark_blocks_and_edges(spark, odd, rows):
    texts = [r[1] for r in rows]
    items = [(1, " ".join(texts[0].split()[:30])), (1, texts[62]), (None, "same same same"), (3, ""), (4, None), (5, texts[4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):
        got = D.contamination(odd, bench, ["doc_id", "text"], 5, block).select("row.text", "found.*").collect()
        expected = dict(zip(texts, brute.contamination(texts, items, 5), strict=True))
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == expected[r.text]
    left = D.decontaminate(odd, bench, 5)
    assert left.columns == odd.columns
    assert left.count() == sum(expected[t][1] == 0 for t in texts)
    assert D.decontaminate(odd, bench.limit(0)).count() == len(rows)
    assert D.decontaminate(odd.limit(0), bench).count() == 0
    assert left.where(F.col("doc_id").isNull() & F.col("text").isNull()).count() == 1
