"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters.

Documents are ranged and sorted by id, so each file holds a stretch of ids and
its stripes and row groups carry narrow id ranges; a reader that asks for some
ids skips files, stripes and row groups by their minima and maxima and by the
Bloom filter on ``doc_id``. Each task encodes its stretch in order and notes
every document's offset in it; the offset of a stretch in the whole sequence is
the sum of the ones before, a table of one row a file. Stripes are read back in
parallel.

Encoding: ``cut_encoder``, each distinct cut of a text once a worker.

The strings of special tokens in a text become their ids, as the library does
unless told otherwise; ``specials=False`` makes them ordinary text, so that no
document can write an id that only the engine sets.

Defined cases: null text is empty, and empty text only has the end id; rows
are ordered by doc_id (null first), then by text digest; repeated rows are written
once each; an empty table writes no rows and reads as none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.cut_encoder import ByteLevelEncoder, encoder
from tessera.llm.tables import map_texts, shared_path
from tessera.llm.words import CHUNK_BYTES, chunks, utf8

END_ID = 2

LAYOUT = "doc_id bigint, part int, in_part bigint, ids array<int>"
ORC = {
    "compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


def encoded(docs: DataFrame, tokenizer: str, order: list, specials: bool = True) -> DataFrame:
    """LAYOUT rows of documents ranged and sorted by ``order``."""
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T._parse_datatype_string(LAYOUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, before = TaskContext.get().partitionId(), 0
        own = encoder(ByteLevelEncoder, tokenizer, specials=specials)
        for batch in batches:
            for first, data, text in chunks(*utf8(batch.column(1)), CHUNK_BYTES):
                n = len(text) - 1
                ids, offs = own.encode(data, text)
                ids = np.insert(ids, offs[1:], END_ID)
                offs = offs + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), pa.array(np.full(n, part, np.int32)), pa.array(before + offs[:-1]),
                    pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))], names=schema.names)
                before += int(offs[-1])

    return map_texts(ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def write_ids(docs: DataFrame, path: str, tokenizer: str, order: list | None = None, specials: bool = True) -> None:
    """Write the token ids of ``docs`` as ORC files under ``path``, in ascending doc_id order unless ``order`` says otherwise."""
    encoded(docs, tokenizer, order or [F.col("doc_id"), F.xxhash64("text")], specials).write.options(**ORC).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files that ``write_ids`` left."""
    rows = spark.read.schema(LAYOUT).orc(path)
    last = rows.groupBy("part").agg(F.max(F.col("in_part") + F.size("ids")).alias("n"))
    # one row a file: bounded by the number of partitions that wrote
    base = last.select(F.col("part").alias("_part"), F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0L)").alias("base"))
    return rows.join(F.broadcast(base), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("base") + F.col("in_part")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian 32-bit integers."""
    schema = T._parse_datatype_string("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = np.frombuffer(ids.values.buffers()[1], "<i4") if len(ids) and ids.values.buffers()[1] is not None else np.empty(0, "<i4")
            flat = flat[ids.values.offset:]
            offs = ids.offsets.to_pylist()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=schema.names)

    return map_texts(rows.select("doc_id", "start", "n_tokens", "ids"), run, schema)


def file_order(docs: DataFrame) -> tuple[DataFrame, list]:
    """(documents, order) that follow the files of a table that Spark has written: by part number, then by row in the file."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = docs.select("doc_id", "text", part.alias("_part"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows, [F.col("_part"), F.col("_file"), F.col("_row")]


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, order: list | None = None) -> DataFrame:
    """Write ``docs`` (to a new shared folder unless ``path`` names one) and describe them from the files."""
    path = path or shared_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, order)
    return with_crc(read_ids(docs.sparkSession, path))
