"""Every registered query against its DuckDB oracle on sf0.001 (the driver's gate, smaller)."""

import os

import pytest

import __spark_entry__ as E

NAMES = sorted(E.queries())


@pytest.mark.skipif(os.environ.get("TESSERA_SKIP_ORACLES") == "1", reason="oracle sweep disabled")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, name):
    from tools.oracle_check import compare
    res = compare(spark, sf_dir, [name], verbose=True)[name]
    assert res[0] in ("OK", "rows-only"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["k", "pass_at_k"]
