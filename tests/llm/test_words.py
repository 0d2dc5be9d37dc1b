import random

import numpy as np
import pyarrow as pa

from tessera.llm.words import ALNUM_LOWER, SPACED, SPACED_LOWER, ranges, words
from tests.llm import brute


def test_words_match_regular_expressions():
    rnd = random.Random(2)
    texts = [None, ""] + ["".join(rnd.choice("aB9 \t\n\x0b,.é日-_\x00\x7f") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    for table, pattern, low in ((SPACED, brute.SPACED, False), (SPACED_LOWER, brute.SPACED, True), (ALNUM_LOWER, brute.ALNUM, True)):
        for limit in (16, 300, 1 << 20):
            got, seen = [], {}
            for chunk in words(pa.array(texts, pa.string()), table, limit):
                data = chunk.data.tobytes()
                for d in range(chunk.n):
                    own = [data[chunk.start[w]:chunk.end[w]].decode() for w in range(chunk.rows[d], chunk.rows[d + 1])]
                    got.append([brute.lower(x) for x in own] if low else own)
                    for w, x in zip(range(chunk.rows[d], chunk.rows[d + 1]), got[-1], strict=True):
                        assert seen.setdefault(x, chunk.hash[w]) == chunk.hash[w]
            assert got == [pattern.findall(brute.lower(t) if low else t or "") for t in texts]
            assert len(set(seen.values())) == len(seen)


def test_ranges():
    assert ranges(np.array([3, 7, 0]), np.array([2, 0, 3])).tolist() == [3, 4, 0, 1, 2]


def test_words_are_hashed_a_block_at_a_time():
    """Sums and powers of all bytes of a chunk were held at once, 32 bytes for each."""
    import tracemalloc

    from tessera.llm import words as W
    values = np.full(W.HASHED_BYTES * 16, 7, np.uint8)
    start = np.arange(0, len(values) - 8, 8)
    end = start + 5
    start, end = np.append(start[:-W.HASHED_BYTES // 4], len(values) - 2 * W.HASHED_BYTES), np.append(end[:-W.HASHED_BYTES // 4], len(values))
    W._powers.clear()
    tracemalloc.start()
    got = W.hashes(values, start, end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(got[:-1].tolist())) == 1 and got[-1] != got[0]  # the last word is longer than a block
    assert peak < 24 * len(values)
