import zlib

import numpy as np
import pytest

from tessera.llm import packing as P
from tessera.llm.queries import tokenizer_file
from tessera.llm.tables import shared_path
from tests.llm.test_token_output import library

WORDS = tokenizer_file("word_bpe_49k.json")


def want(texts, longest):
    """(document, start, ids) of each piece by a plain loop."""
    out = []
    for k, ids in enumerate(library(texts, "word_bpe_49k.json")):
        ids, at = ids + [2], 0
        while at < len(ids):
            n = longest
            while n > len(ids) - at:
                n //= 2
            out.append((k, at, ids[at:at + n]))
            at += n
    return out


def test_decomposition():
    n = np.array([1, 2, 3, 4095, 4096, 4097, 3 * 4096 + 5, 0])
    doc, length = P.decomposition(n, 4096)
    assert [length[doc == k].tolist() for k in (0, 2, 5, 6, 7)] == [[1], [2, 1], [4096, 1], [4096, 4096, 4096, 4, 1], []]
    assert [int(length[doc == k].sum()) for k in range(len(n))] == n.tolist()
    assert P.decomposition(np.array([3]), 1)[1].tolist() == [1, 1, 1]


@pytest.mark.parametrize("longest", [4096, 64])
def test_buckets_round_trip(spark, odd, rows, longest):
    path = shared_path(spark, "test-buckets")
    P.write_buckets(odd, path, WORDS, longest)
    back = P.read_buckets(spark, path)
    got = back.collect()
    texts = [r[1] for r in rows]
    pieces = want(texts, longest)
    assert sorted((repr(rows[k][0]), s, p) for k, s, p in pieces) == sorted((repr(r.doc_id), r.start, r.ids) for r in got)
    assert all(len(r.ids) == r.length and r.length & (r.length - 1) == 0 and r.length <= longest for r in got)
    assert len({r.sequence_id for r in got}) == len(got)
    digests = {r.sequence_id: r for r in P.piece_digests(back).collect()}
    for r in got:
        d = digests[r.sequence_id]
        assert (d.doc_id, d.start, d.length, d.doc_tokens, d.offset) == (r.doc_id, r.start, r.length, r.doc_tokens, 0)
        assert d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    sizes = {r.length: (r.n_sequences, r.n_tokens) for r in P.bucket_sizes(back).collect()}
    assert sum(t for _, t in sizes.values()) == sum(len(p) for _, _, p in pieces)
    assert P.read_buckets(spark, path, 16).count() == sizes[16][0]
    assert "PartitionFilters: [isnotnull(length" in P.read_buckets(spark, path, 16)._jdf.queryExecution().toString()


def test_empty_table_and_lengths(spark, odd):
    assert P.packed(odd.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        P.pieces(odd, WORDS, 1000)
