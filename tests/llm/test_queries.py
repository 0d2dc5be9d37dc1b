"""Registered queries against their DuckDB statements and the plain versions."""

import pytest

from tessera.llm import queries
from tests.llm import brute
from tools.oracle_check import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    assert compare(spark, sf_dir, [name])[name][0] == "OK"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_plain_versions(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r[1:5]) for r in queries.op1_suffix_array_decontamination(spark, sf_dir).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.contamination([t for _, t in rows], items, 10), strict=True)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_odd_sketch_near_dedup(spark, sf_dir).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.near(rows, 3, 85), strict=True)}
    got = {r.doc_id: tuple(r[1:6]) for r in queries.op6_adaptive_quality(spark, sf_dir).collect()}
    assert got == {i: (lambda q: (*q[:3], *q[4:]))(brute.quality(t)) for i, t in rows}
