"""Byte-level BPE against a plain trainer."""

import random
from collections import Counter

import pytest
import regex

from tessera.operators import bpe as B

SPECIALS = ["[PAD]", "[UNK]", "[BOQ]", "[EOQ]"]


def plain_words(text):
    text = text or ""
    return regex.findall(B.BYTE_LEVEL_PATTERN, text if text[:1] in ("", " ") else " " + text)


def plain(texts, vocab_size, min_freq):
    """Merges and ids, counting all pairs anew for each merge."""
    chars = B.byte_characters()
    words = Counter(w for t in texts for w in plain_words(t))
    state = {w: [chars[b] for b in w.encode()] for w in words}
    ids = {t: k for k, t in enumerate([*SPECIALS, *sorted({c for s in state.values() for c in s} | set(B.INITIAL_ALPHABET))])}
    merges = []
    while len(ids) < vocab_size:
        counts = Counter()
        for w, s in state.items():
            for p in zip(s, s[1:], strict=False):
                counts[p] += words[w]
        if not counts:
            break
        pair, n = min(counts.items(), key=lambda x: (-x[1], ids[x[0][0]], ids[x[0][1]]))
        if n < min_freq:
            break
        merges.append((*pair, n))
        ids.setdefault("".join(pair), len(ids))
        for w, s in state.items():
            out, i = [], 0
            while i < len(s):
                both = tuple(s[i:i + 2]) == pair
                out.append("".join(pair) if both else s[i])
                i += 1 + both
            state[w] = out
    return merges, ids


def test_hand_example(spark):
    df = spark.createDataFrame([("low low low lower newest newest",)], "text string")
    got = B.train_bpe(df, vocab_size=1 << 20, max_merges=2)
    assert [m[:2] for m in got.merges] == [("l", "o"), ("\u0120", "lo")] and got.merges[0][2] == 4


@pytest.mark.parametrize("sample, batch", [(1 << 16, 512), (40, 32), (0, 16)])
def test_equals_plain_trainer_whatever_the_sample(spark, sf_dir, sample, batch):
    """A sample that leaves words out makes wrong guesses, which the exact counts drop."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(25)
    texts = [r.text for r in docs.collect()] + [None, "", "aaaa aaaaa  aa\n\n aaa", "it's we'll \u00e9\u6f22 \U0001f600 3.14"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    size = 330 if sample else 180
    got = B.train_bpe(df, vocab_size=size, sample_words=sample, batch=batch)
    merges, ids = plain(texts, size, 2)
    assert got.merges == merges and got.ids == ids and sorted(ids.values()) == list(range(len(ids)))


def test_close_counts_take_few_rounds(spark):
    """Words that the driver doesn't hold made guesses wrong and a job was run for every few merges (F2)."""
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(60)) for _ in range(25)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    spark.sparkContext.setJobGroup("bpe-rounds", "close counts")
    got = B.train_bpe(df, vocab_size=230, sample_words=300)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bpe-rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    merges, ids = plain(texts, 230, 2)
    assert got.merges == merges and got.ids == ids and len(merges) > 150
    assert jobs < 45


def test_stops_at_min_freq(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([("".join(rnd.choice("abc ") for _ in range(400)),)], "text string")
    for least in (2, 9):
        got = B.train_bpe(df, vocab_size=8000, min_freq=least)
        assert got.merges == plain([df.first().text], 8000, least)[0] and got.merges[-1][2] >= least
    assert B.train_bpe(df.limit(0), vocab_size=8000).merges == []


def test_encoding_splits_by_merges(spark, sf_dir):
    texts = ["[BOQ] low lower [EOQ]", "lowlow\u00e9", None, "", "slow[EOQ]er  w\n", "low [PAD] x"]
    df = spark.createDataFrame(list(enumerate(["low low low lower newest newest"])), "k int, text string")
    bpe = B.train_bpe(df, vocab_size=60)
    got = {r.k: r.ids for r in B.encode_bpe(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"], "t", bpe).collect()}
    rank, chars = {(a, b): k for k, (a, b, _) in enumerate(bpe.merges)}, B.byte_characters()
    for k, t in enumerate(texts):
        want = []
        for part in regex.split(r"(\[PAD\]|\[UNK\]|\[BOQ\]|\[EOQ\])", t or ""):
            if part in SPECIALS:
                want.append(bpe.ids[part])
                continue
            for w in plain_words(part):
                want += [bpe.ids.get(s, 1) for s in B.split_by_merges([chars[b] for b in w.encode()], rank)]
        assert got[k] == want, t


def test_many_words_meet_as_few_pieces(spark):
    """Words of one stem share their pieces; whole words came to the driver in rounds of ``sample_words`` (F1)."""
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abcdefghijkl") for _ in range(2)) for _ in range(40)]
    texts = [" ".join("".join(rnd.choice(stems) for _ in range(rnd.randint(2, 4))) for _ in range(200)) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    spark.sparkContext.setJobGroup("bpe-pieces", "few pieces")
    got = B.train_bpe(df, vocab_size=300, sample_words=300)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bpe-pieces"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    merges, ids = plain(texts, 300, 2)
    assert got.merges == merges and got.ids == ids and len(merges) > 200
    assert jobs < 50


def test_rows_of_one_letter(spark):
    rnd = random.Random(11)
    texts = [" ".join("".join(rnd.choice("aaab") for _ in range(rnd.randint(3, 14))) for _ in range(90)) for _ in range(6)] + ["a" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = B.train_bpe(df, vocab_size=150, sample_words=120)
    assert (got.merges, got.ids) == plain(texts, 150, 2)


def test_merges_are_applied_in_order():
    rnd, letters = random.Random(2), "abc"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    learned, names = plain([" ".join(words)], 200, 2)
    ids = {t: k for k, t in enumerate(dict.fromkeys([*letters, *(a + b for a, b, _ in learned if "Ġ" not in a + b)]))}
    merges = B.np.array([(ids[a], ids[b], ids[a + b]) for a, b, _ in learned if "Ġ" not in a + b], B.np.int32)
    flat = B.np.array([x for w in words for x in [*(ids[c] for c in w), -1]], B.np.int32)
    symbols, freq = B.replayed(flat, B.np.arange(len(words)), merges)
    got = dict(zip(freq.tolist(), " ".join(map(str, symbols.tolist())).split("-1"), strict=False))
    for k, w in enumerate(words):
        state = [ids[c] for c in w]
        for a, b, made in merges.tolist():
            out, i = [], 0
            while i < len(state):
                both = state[i:i + 2] == [a, b]
                out.append(made if both else state[i])
                i += 1 + both
            state = out
        assert [int(x) for x in got[k].split()] == state
