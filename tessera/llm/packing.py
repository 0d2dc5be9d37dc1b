"""Packing by power-of-two decomposition: no padding, no sequence across documents.

A document of n tokens is cut into pieces whose lengths are powers of two: as
many of the greatest length as fit, then one for each binary digit of the rest,
from the longest to the shortest. Every piece is a sequence of its own, and
sequences of one length lie in one bucket, so a batch from a bucket needs no
padding and attention never reaches another document.

A task reads texts where they lie, encodes them and writes each piece to its
bucket (a folder ``length=...``): nothing is shuffled or sorted across tasks,
whatever key or copy is frequent. A document's ids are held by one task, as its
text is. A sequence's number is made of its task's number and its place there,
so a task that is run again makes the same.

Defined cases: null text is empty, and empty text has the end id only, one
piece of length 1; repeated rows and ids are packed once each; an empty table
writes no buckets and reads as none. Other columns are neither read nor changed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.cut_encoder import WordEncoder, encoder
from tessera.llm.tables import shared_path
from tessera.llm.words import CHUNK_BYTES, chunks, utf8

END_ID = 2
LONGEST = 4096
TASK_SEQUENCES = 1 << 36

PIECE = "doc_id bigint, start bigint, length int, doc_tokens bigint, sequence_id bigint, ids array<int>"


def decomposition(n_tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of every piece, documents in order, long pieces first; ``longest`` is a power of two."""
    digits = 2 ** np.arange(longest.bit_length() - 2, -1, -1, dtype=np.int64)
    rest = (n_tokens[:, None] & digits) != 0
    doc, digit = np.nonzero(rest)
    whole = np.repeat(np.arange(len(n_tokens)), n_tokens // longest)
    both = np.concatenate([whole, doc])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([np.full(len(whole), longest, np.int64), digits[digit]])[order]


def pieces(docs: DataFrame, tokenizer: str, longest: int = LONGEST, specials: bool = True) -> DataFrame:
    """PIECE rows of all documents."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"the greatest length must be a power of two, not {longest}")
    schema = T._parse_datatype_string(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() * TASK_SEQUENCES
        own = encoder(WordEncoder, tokenizer, specials=specials)
        for batch in batches:
            for first, data, text in chunks(*utf8(batch.column(1)), CHUNK_BYTES):
                ids, offs = own.encode(data, text)
                ids = np.insert(ids, offs[1:], END_ID)
                offs = offs + np.arange(len(text))
                n_tokens = np.diff(offs)
                doc, length = decomposition(n_tokens, longest)
                begin = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(text) - 1).take(pa.array(doc)), pa.array(begin[:-1] - offs[doc]), pa.array(length.astype(np.int32)),
                    pa.array(n_tokens[doc]), pa.array(number + np.arange(len(doc), dtype=np.int64)),
                    pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))], names=schema.names)
                number += len(doc)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def write_buckets(docs: DataFrame, path: str, tokenizer: str, longest: int = LONGEST, specials: bool = True) -> None:
    """Write the sequences of ``docs`` under ``path``, a folder for each length."""
    pieces(docs, tokenizer, longest, specials).write.partitionBy("length").parquet(path)


def read_buckets(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """PIECE rows that ``write_buckets`` left; of one bucket, whose folder alone is read, if ``length`` names it."""
    rows = spark.read.schema(PIECE).parquet(path)
    return rows if length is None else rows.where(F.col("length") == length)


def bucket_sizes(rows: DataFrame) -> DataFrame:
    """(length, n_sequences, n_tokens) of each bucket, from which a sampler draws its batches."""
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("n_sequences")).withColumn("n_tokens", F.col("n_sequences") * F.col("length"))


def piece_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece; the crc32 is that of little-endian 32-bit ids."""
    schema = T._parse_datatype_string("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(5)
            offs = ids.offsets.to_numpy() * 4
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B") if len(ids) else memoryview(b"")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            # a sequence holds one piece, which begins it
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(crc, pa.int64()), batch.column(3), batch.column(4),
                pa.array(np.zeros(len(crc), np.int64))], names=schema.names)

    return rows.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "ids").mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the buckets of ``docs`` (to a new shared folder unless ``path`` names one) and describe their pieces from the files."""
    path = path or shared_path(docs.sparkSession, "buckets")
    write_buckets(docs, path, tokenizer)
    return piece_digests(read_buckets(docs.sparkSession, path))
