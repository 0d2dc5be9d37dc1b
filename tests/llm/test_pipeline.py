"""The pipeline against a plain version of each stage."""

import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import quality  # noqa: E402
from tests.llm import brute  # noqa: E402
from tests.llm.test_token_output import library  # noqa: E402


def test_stages(spark, odd, rows, tmp_path):
    root = str(tmp_path)
    items = [(1, " ".join(rows[40][1].split()[:25])), (2, "nothing of the kind in any of these documents at all here")]
    odd.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    left = [(r[0], r[1]) for r in rows]
    passed = {(r.row.doc_id, r.row.text) for r in quality.judged(docs, ["doc_id", "text"]).where("verdict.passed").collect()}
    want = [r for r in left if r in passed]
    assert all(brute.quality(t)[0] >= 50 for _, t in want)
    same = brute.near(want, 5, 80)
    want = sorted({r for r, s in zip(want, same, strict=True) if r[0] == s[1]}, key=repr)
    hit = brute.contamination([t for _, t in want], items, 10)
    want = [r for r, h in zip(want, hit, strict=True) if not h[1]]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], (None, None, want, want), strict=True):
        out = stage(spark, docs, root)
        assert out.columns == odd.columns, name
        path = f"{root}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if expected is not None:
            assert sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr) == expected
    order = [r.doc_id for r in docs.select("doc_id").collect()]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, root).orderBy("start").collect()
    assert [r.doc_id for r in got] == order  # one file a task: rows come in the order of the files
    ids = {i: x + [2] for (i, _), x in zip(want, library([t for _, t in want]), strict=True)}
    assert all(r.n_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()) for r in got)
    whole = corpus_pipeline.run(spark, root).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in got)
