import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import token_output as O
from tessera.llm.queries import tokenizer_file
from tessera.llm.tables import shared_path
from tessera.llm.words import chunks, utf8


def library(texts, name="byte_bpe_50k.json", specials=True):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file(name))
    t.encode_special_tokens = not specials
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_files_round_trip(spark, odd, rows):
    path = shared_path(spark, "test-ids")
    O.write_ids(odd, path, tokenizer_file())
    back = O.read_ids(spark, path).orderBy("start").collect()
    crc = {r.start: r for r in O.with_crc(O.read_ids(spark, path)).collect()}
    assert len(back) == len(rows) and sorted((r.doc_id is not None, r.doc_id or 0) for r in back) == [(r.doc_id is not None, r.doc_id or 0) for r in back]
    assert sorted(map(list, (r.ids for r in back))) == sorted(i + [2] for i in library([r[1] for r in rows]))
    at = 0
    for r in back:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert crc[at].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert O.token_table(odd.limit(0), tokenizer_file()).count() == 0


def test_metadata_prunes(spark, docs):
    path = shared_path(spark, "test-bloom")
    O.write_ids(docs, path, tokenizer_file())
    plan = O.read_ids(spark, path).where(F.col("doc_id") == 7)
    assert plan.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in plan._jdf.queryExecution().toString()
