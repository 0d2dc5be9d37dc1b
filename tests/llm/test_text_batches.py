import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm.decontaminate import gathered
from tessera.llm.tables import BATCH_BYTES, map_texts


def sizes():
    def run(batches):  # goes to the workers by value
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})
    return run


def test_long_texts_come_in_small_batches(spark):
    rows = spark.range(0, 8000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 300).alias("text"))
    got = map_texts(rows, sizes(), "n long, size long").collect()
    assert sum(r.n for r in got) == 8000
    assert max(r.size for r in got) < BATCH_BYTES + 65536


def test_a_row_larger_than_a_batch_passes(spark):
    rows = spark.range(0, 3, 1, 1).select(F.repeat(F.lit("0123456789"), BATCH_BYTES // 5).alias("text"))
    assert [r.n for r in map_texts(rows, sizes(), "n long, size long").collect()] == [1, 1, 1]


def test_gathered_keeps_rows_and_order():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(i, i + 10))}) for i in range(0, 100, 10)]
    out = list(gathered(iter(batches), 200))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(100))
    assert all(b.nbytes >= 200 for b in out[:-1]) and len(out) < 10
    assert list(gathered(iter([]))) == []
