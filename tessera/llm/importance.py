"""Importance resampling towards a target: hashed n-gram features, head and tail vocabulary.

Features of a text are its words and pairs of neighbouring words; a feature's
bucket is the CRC-32 of its bytes modulo the number of buckets. Feature counts
by bucket of the corpus and of the target give each bucket a gain (how much
likelier the target is to hold it), and a document's weight is the mean gain of
its features. Documents are drawn without replacement by weight plus Gumbel
noise that a digest of the id gives.

Head and tail: tasks keep the most frequent words and pairs in a summary of
fixed size (counters that lose the same amount when there are too many, so that
summaries of parts add up to one of the whole). The ``HEAD`` most frequent of
each are broadcast: for a word the CRC of its bytes, from which that of a pair
goes on, for a pair its bucket. A word or pair that the head doesn't hold takes
its CRC directly, byte by byte. Either way the bucket is exact, so the totals
don't depend on what the head holds; it only saves work. The head is a table of
at most ``HEAD`` entries a kind and the totals one of ``BUCKETS``, whatever the
corpus; every document counts for both.

Ranks: scores are whole numbers within a bounded range, so a table of their
counts (one row a score) says how many documents lie above each; only documents
of one score are put in order by id. No document's text is shuffled.

Defined cases: a null or empty text, or one without words, has no features and
weight 0; it can't be drawn, having fewer than ``least_words`` words. Ties go
to the smaller doc_id, then to the smaller text hash; a null doc_id comes last,
and its noise is that of an empty id. Repeated rows are drawn one by one. An empty corpus
gives no rows; an empty target has no counts, which the gains allow. Other
columns are neither read nor changed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.tables import scratch, stored
from tessera.llm.words import ALNUM_LOWER, Words, mix, row_sums, words

BUCKETS = 10000
HEAD = 1 << 15
SLOTS = 1 << 20
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: longer words take their CRC from zlib, one by one
LONG_WORD = 64

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def crc_extended(crc: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of strings of which ``crc`` is that of the bytes before ``values[start:end]``."""
    state = ~crc.astype(np.uint32)
    size = end - start
    order = np.argsort(size, kind="stable")[::-1]
    sizes = size[order]
    short = int(np.searchsorted(-sizes, -LONG_WORD, side="left"))
    for k in order[:short].tolist():
        state[k] = np.uint32(~np.uint32(zlib.crc32(values[start[k]:end[k]].tobytes(), int(crc[k]))))
    order, sizes = order[short:], sizes[short:]
    own, at = state[order], start[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step, side="left"))  # words with more than ``step`` bytes
        own[:n] = _TABLE[(own[:n] ^ values[at[:n] + step]) & 255] ^ (own[:n] >> 8)
    state[order] = own
    return ~state


def crc_blank(crc: np.ndarray) -> np.ndarray:
    """CRC-32 with a space after what ``crc`` is of."""
    state = ~crc
    return ~(_TABLE[(state ^ 32) & 255] ^ (state >> 8))


class Head:
    """Values of the frequent keys, found in one look; a key whose place another holds counts as tail."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values.astype(np.uint32)
        self.place = np.full(SLOTS, -1, np.int32)
        self.place[(keys & np.uint64(SLOTS - 1)).astype(np.int64)[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), np.uint32), np.zeros(len(keys), bool)
        at = self.place[(keys & np.uint64(SLOTS - 1)).astype(np.int64)]
        found = (at >= 0) & (self.keys[at] == keys)
        return self.values[at], found


@dataclass
class Features:
    """Words of a chunk and the pairs of neighbours in a row; a pair is named by its first word."""

    chunk: Words
    values: np.ndarray
    pair: np.ndarray
    pair_key: np.ndarray

    @classmethod
    def of(cls, chunk: Words) -> Features:
        n = len(chunk.hash)
        last = np.zeros(n + 1, bool)
        last[chunk.rows[1:] - 1] = True  # of an empty row: the last word of one before it, or none
        last[-1] = False
        pair = np.flatnonzero(~last[:n])
        return cls(chunk, ALNUM_LOWER[chunk.data], pair, mix(mix(chunk.hash[pair], 11) ^ chunk.hash[pair + 1], 12))

    def crc(self, begun: np.ndarray, word: np.ndarray) -> np.ndarray:
        """CRC-32 of strings that the words end, byte by byte; ``begun`` is that of what stands before."""
        return crc_extended(begun, self.values, self.chunk.start[word], self.chunk.end[word])

    def buckets(self, words_head: Head, pairs_head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each word and of each pair."""
        crc, found = words_head.find(self.chunk.hash)
        tail = np.flatnonzero(~found)
        crc[tail] = self.crc(np.zeros(len(tail), np.uint32), tail)
        bucket, found = pairs_head.find(self.pair_key)
        tail = np.flatnonzero(~found)
        word = self.pair[tail]
        bucket[tail] = self.crc(crc_blank(crc[word]), word + 1) % np.uint32(buckets)
        return crc % np.uint32(buckets), bucket


class Frequent:
    """Counters of the most frequent keys and a value of each; summaries of parts of the data add up to one of the whole.

    When more than twice ``size`` keys are held, the count of the first that is
    too many is taken from all, and those left with nothing go.
    """

    def __init__(self, size: int):
        self.size = size
        self.keys, self.counts, self.values = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def add(self, keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys, the counts of each and its value."""
        if not len(keys):
            return
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.values = keys[first], np.concatenate([self.values, values])[order][first]
        self.counts = np.add.reduceat(np.concatenate([self.counts, counts])[order], first)
        if len(self.keys) > 2 * self.size:
            self.trim()

    def trim(self) -> None:
        """At most ``size`` keys."""
        n = len(self.keys)
        if n > self.size:
            self.counts = self.counts - np.partition(self.counts, n - self.size - 1)[n - self.size - 1]
            left = self.counts > 0
            self.keys, self.counts, self.values = self.keys[left], self.counts[left], self.values[left]


def frequent(docs: DataFrame, buckets: int, size: int) -> tuple[Head, Head]:
    """Heads of at most ``size`` words (with the CRC of each) and pairs (with the bucket of each)."""
    schema = T._parse_datatype_string("pair boolean, key bigint, n bigint, value bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Frequent(size), Frequent(size))
        for batch in batches:
            for chunk in words(batch.column(0), ALNUM_LOWER):
                f = Features.of(chunk)
                keys, first, counts = np.unique(chunk.hash, return_index=True, return_counts=True)
                crc = f.crc(np.zeros(len(first), np.uint32), first)
                held[0].add(keys, counts, crc)
                by_word = np.zeros(len(chunk.hash), np.uint32)
                by_word[first] = crc
                pair_keys, pair, counts = np.unique(f.pair_key, return_index=True, return_counts=True)
                word = f.pair[pair]
                begun = crc_blank(by_word[first[np.searchsorted(keys, chunk.hash[word])]])
                held[1].add(pair_keys, counts, f.crc(begun, word + 1) % np.uint32(buckets))
        for kind, own in enumerate(held):
            own.trim()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(own.keys), bool(kind))), pa.array(own.keys.view(np.int64)), pa.array(own.counts),
                pa.array(own.values.astype(np.int64))], names=schema.names)

    counted = stored(docs.select("text").mapInArrow(run, schema).groupBy("pair", "key").agg(F.sum("n").alias("n"), F.min("value").alias("value")), "frequent")
    heads = []
    for pair in (False, True):  # at most ``size`` rows each
        top = counted.where(F.col("pair") == pair).orderBy(F.col("n").desc(), "key").limit(size).toPandas()
        heads.append(Head(top["key"].to_numpy(np.int64).view(np.uint64), top["value"].to_numpy(np.int64)))
    return heads[0], heads[1]


def bucket_totals(docs: DataFrame, heads, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; ``heads`` is a broadcast of both heads."""
    schema = T._parse_datatype_string("bucket int, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in words(batch.column(0), ALNUM_LOWER):
                for own in Features.of(chunk).buckets(*heads.value, buckets):
                    total += np.bincount(own, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(total)], names=schema.names)

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in the target and in the corpus, in thousandths, floored."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, heads, gains: np.ndarray) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight) of every document."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("text_key bigint, n_words bigint, n_features bigint, weight bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words(batch.column(2), ALNUM_LOWER):
                f = Features.of(chunk)
                word, pair = f.buckets(*heads.value, len(gains))
                own = gains[word]
                own[f.pair] += gains[pair]
                n_words = np.diff(chunk.rows)
                n = n_words + np.maximum(n_words - 1, 0)
                weight = row_sums(own, chunk.rows) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.first, chunk.n) for i in (0, 1)), *map(pa.array, (n_words, n, weight))], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, head: int = HEAD, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score): weight by the target's feature counts, score with Gumbel noise."""
    heads = docs.sparkSession.sparkContext.broadcast(frequent(docs, buckets, head))
    gains = bucket_gains(bucket_totals(docs, heads, buckets), bucket_totals(target, heads, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed(docs, heads, gains).withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rows`` of ``scored``, stored, with ``rank``: 1, 2, 3... of the ``percent`` of long enough documents with the highest scores, else null."""
    able = rows.where(F.col("n_words") >= least_words)
    # one row a score: scores span less than 200,000 whole numbers for any corpus under 2^63 features
    counts = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = counts.select(F.col("score").alias("_score"), F.expr(
        "coalesce(sum(n) over (order by score desc rows between unbounded preceding and 1 preceding), 0L)").alias("_above"), F.expr("sum(n) over ()").alias("_all"))
    placed = able.join(F.broadcast(above), F.col("score") == F.col("_score"))
    quota = F.expr(f"{percent} * _all div 100")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "text_key")
    at = F.col("_above") + F.row_number().over(order)
    inside = placed.where(F.col("_above") < quota).withColumn("rank", F.when(at <= quota, at))
    outside = placed.where(F.col("_above") >= quota).withColumn("rank", F.lit(None).cast("long"))
    short = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = [*rows.columns, "rank"]
    return inside.select(*names).unionByName(outside.select(*names)).unionByName(short.select(*names))


def resampled(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score, rank) of every document of ``docs``; drawn ones have a rank."""
    with scratch(docs.sparkSession, "importance"):
        rows = stored(scored(docs, target, **options), "scores")
        return stored(drawn(rows, least_words, percent), "importance-ranks", keep=True)


def oracle(buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """DuckDB statement of the query. CRC-32 is a fold over the bytes of each distinct feature."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words_ = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    step = "lambda t, k: case when t % 2 = 1 then xor(t // 2, 3988292384) else t // 2 end"
    return f"""
with crc_table as (select list(v order by i) as tab from (select i, list_reduce(range(8), {step}, i) as v from range(256) r(i))),
d as (select row_number() over () as i, doc_id, {words_} as w from documents),
f as (select i, unnest(list_concat(w, list_transform(range(greatest(len(w) - 1, 0)), lambda a: w[a + 1] || ' ' || w[a + 2]))) as x from d),
g as (select unnest(list_concat(w, list_transform(range(greatest(len(w) - 1, 0)), lambda a: w[a + 1] || ' ' || w[a + 2]))) as x from (select {words_} as w from benchmark)),
names as (select x, hex(encode(x)) as h from (select x from f union select x from g)),
crcs as (select x, xor(list_reduce(list_transform(range(len(h) // 2), lambda k: cast('0x' || h[2 * k + 1:2 * k + 2] as bigint)),
  lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295), 4294967295) % {buckets} as bucket from names, crc_table),
s as (select bucket, count(*) as s from f join crcs using (x) group by bucket),
t as (select bucket, count(*) as t from g join crcs using (x) group by bucket),
gains as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from f) + {buckets})::double
  / ((coalesce(s, 0) + 1)::double * ((select count(*) from g) + {buckets})::double)))::bigint as gain from (select distinct bucket from crcs) left join s using (bucket) left join t using (bucket)),
sums as (select i, sum(gain) as total, count(*) as n from f join crcs using (x) join gains using (bucket) group by i),
w as (select d.i, doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(floor(total::double / n), 0)::bigint as weight from d left join sums on d.i = sums.i),
h as (select *, cast('0x' || sha256('{seed}:' || coalesce(doc_id::varchar, ''))[1:8] as bigint)::double as h from w),
scores as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::bigint as score from h),
ranks as (select i, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scores where n_words >= {least_words})
select doc_id, n_features, weight, score, case when r <= {percent} * n // 100 then r end as rank from scores left join ranks on scores.i = ranks.i
"""
