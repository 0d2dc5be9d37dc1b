"""Benchmark decontamination with suffix arrays over shards of the corpus.

Each task cuts its documents into shards of bounded size and builds a suffix
array over the words of a shard. Every suffix of every benchmark item is looked
up in it by binary search: the window at its start gives the range of corpus
suffixes that begin with it, and so every occurrence and its place; from there
the longest verbatim match is read off. No document leaves its task, so there
is no shuffle, and a passage in a third of all documents is a longer range in
every shard.

A word that no benchmark item holds ends a suffix: nothing matches across it.
So the array only holds suffixes with at least as many benchmark words as the
shortest window, sorted to the length of the longest item, which is all that a
search can tell apart.

The benchmark is read in blocks of at most ``block_bytes`` of text; each is a
broadcast of that size, searched one after the other in every shard.

Defined cases: null text has no words; an item of no words has no window; an
item of fewer words than the window is one window; items that share an id count
once; an item without id counts as id ""; repeated documents and repeated rows
are each judged alone; an empty benchmark leaves every document clean; no
documents give no rows. Other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import map_texts
from tessera.llm.words import ALNUM_LOWER, Words, ranges, row_sums, words

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
#: bytes of rows that each block of a larger benchmark is prepared for
GATHERED_BYTES = 32 << 20

MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_word", T.LongType()),
                      T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("longest_match", T.LongType()),
    T.StructField("matches", T.ArrayType(MATCH)), T.StructField("contaminated", T.BooleanType())])


@dataclass
class Queries:
    """A block of benchmark items, ready for search.

    vocab/known: sorted word hashes and a prefilter on their first 20 bits;
    spelling: the words behind them; text: word ids of all items, 0 after each;
    item: item index of each word; windows: distinct windows (ids, padded with
    0) and their lengths; at/by: positions of windows in text, grouped by window.
    """

    ids: list
    vocab: np.ndarray
    known: np.ndarray
    spelling: list[bytes]
    text: np.ndarray
    item: np.ndarray
    item_start: np.ndarray
    left: np.ndarray
    windows: np.ndarray
    length: np.ndarray
    by: np.ndarray
    at: np.ndarray


def prepare(items: list[tuple], window: int) -> Queries | None:
    """Windows of a block of (item_id, text) rows; None if there is no word."""
    found: list[tuple[int, list[int]]] = []
    number: dict[bytes, int] = {}
    hashes: dict[int, int] = {}
    for chunk in words(pa.array([t for _, t in items], pa.string()), ALNUM_LOWER):
        lower = ALNUM_LOWER[chunk.data].tobytes()
        for k in range(chunk.n):
            ids = []
            for w in range(chunk.rows[k], chunk.rows[k + 1]):
                word = lower[chunk.start[w]:chunk.end[w]]
                ids.append(number.setdefault(word, len(number) + 1))
                hashes[ids[-1]] = int(chunk.hash[w])
            if ids:
                found.append((chunk.first + k, ids))
    if not found:
        return None
    order = sorted(hashes, key=hashes.get)  # word ids by hash
    rank = {w: i + 1 for i, w in enumerate(order)}
    by_id = {i: w for w, i in number.items()}
    vocab = np.array([hashes[w] for w in order], dtype=np.uint64)
    known = np.zeros(1 << 20, dtype=bool)
    known[(vocab >> np.uint64(44)).astype(np.int64)] = True
    text, item, left, start = [], [], [], []
    for index, ids in found:
        start += [len(text)] * (len(ids) + 1)
        text += [rank[w] for w in ids] + [0]
        item += [index] * (len(ids) + 1)
        left += list(range(len(ids), -1, -1))
    text_, left_ = np.array(text, np.int32), np.array(left, np.int64)
    start_ = np.array(start, np.int64)
    whole = start_ == np.arange(len(text_))
    at = np.flatnonzero((left_ >= window) | whole & (left_ > 0))
    padded = np.concatenate([text_, np.zeros(window, np.int32)])
    table = padded[at[:, None] + np.arange(window)]
    table[np.arange(window) >= left_[at][:, None]] = 0
    windows, by = np.unique(table, axis=0, return_inverse=True)
    by = by.reshape(-1)
    at = at[np.argsort(by, kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(by, minlength=len(windows)))])
    return Queries([i for i, _ in items], vocab, known, [by_id[w] for w in order], text_, np.array(item), start_, left_,
                   windows, (windows != 0).sum(axis=1), offsets, at)


def corpus_ids(chunk: Words, q: Queries, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Benchmark word id of each corpus word (0: none), and how many follow one another from there."""
    n = len(chunk.hash)
    ids = np.zeros(n + 1, np.int32)
    maybe = np.flatnonzero(q.known[(chunk.hash >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(q.vocab, chunk.hash[maybe]), len(q.vocab) - 1)
    ids[maybe] = np.where(q.vocab[place] == chunk.hash[maybe], place + 1, 0)
    run = runs(ids, chunk)
    # words that can be part of a match are compared by spelling, not only by hash
    lower = ALNUM_LOWER[chunk.data].tobytes()
    wrong = [w for w in long_runs(run, shortest).tolist() if lower[chunk.start[w]:chunk.end[w]] != q.spelling[ids[w] - 1]]
    if wrong:
        ids[wrong] = 0
        run = runs(ids, chunk)
    return ids, run


def runs(ids: np.ndarray, chunk: Words) -> np.ndarray:
    """Words from each position to the next word that is not in the benchmark, or to the end of its document."""
    n = len(ids) - 1
    stop = np.where(ids[:n] == 0, np.arange(n), n)
    ends = chunk.rows[1:][chunk.rows[1:] > chunk.rows[:-1]]
    limit = np.full(n + 1, n, np.int64)
    limit[:n] = stop
    inner = ends[ends < n]
    # a document's end stops the words before it: compare with the first word of the next one
    following = np.minimum.accumulate(limit[::-1])[::-1]
    next_end = np.full(n + 1, n, np.int64)
    next_end[inner - 1] = inner
    if len(ends) and ends[-1] == n and n:
        next_end[n - 1] = n
    next_end = np.minimum.accumulate(next_end[::-1])[::-1]
    return np.minimum(following, next_end) - np.arange(n + 1)


def long_runs(run: np.ndarray, shortest: int) -> np.ndarray:
    """Positions in runs of at least ``shortest`` benchmark words."""
    n = len(run) - 1
    begin = np.flatnonzero((run[:n] > 0) & (np.concatenate([[0], run[:n - 1]]) != run[:n] + 1))
    begin = begin[run[begin] >= shortest]
    return ranges(begin, run[begin])


def suffix_array(ids: np.ndarray, run: np.ndarray, shortest: int, depth: int) -> np.ndarray:
    """Positions whose suffix holds ``shortest`` words or more, sorted by their first ``depth`` words (prefix doubling)."""
    active = long_runs(run, shortest)
    rank = np.zeros(len(ids), np.int64)
    rank[active] = ids[active]
    step = 1
    while step < depth and len(active):
        far = active + step
        second = np.where(run[active] > step, rank[np.minimum(far, len(ids) - 1)], 0)
        _, dense = np.unique(rank[active] * np.int64(len(ids) + (1 << 31)) + second, return_inverse=True)
        rank[active] = dense + 1
        if dense.max() + 1 == len(active):
            break
        step *= 2
    kept = active[run[active] >= shortest]
    return kept[np.argsort(rank[kept], kind="stable")]


def search(sa: np.ndarray, ids: np.ndarray, run: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of ``sa`` whose suffixes begin with it."""
    width = q.windows.shape[1]
    column = np.arange(width)
    padded = np.concatenate([ids, np.zeros(width, np.int32)])
    inside = column < q.length[:, None]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(q.windows), np.int64), np.full(len(q.windows), len(sa), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) >> 1
            at = sa[mid]
            here = np.where((column < run[at][:, None]) & inside[open_], padded[at[:, None] + column], 0)
            differs = here - q.windows[open_]
            first = (differs != 0).argmax(axis=1)
            sign = differs[np.arange(len(open_)), first]
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]

    return bound(False), bound(True)


def longest(ids: np.ndarray, run: np.ndarray, q: Queries, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Length of the common prefix of item suffixes ``at`` and corpus suffixes ``place``."""
    length = np.zeros(len(at), np.int64)
    most = np.minimum(q.left[at], run[place])
    alive = np.arange(len(at))
    while len(alive):
        k = length[alive]
        same = (k < most[alive]) & (q.text[np.minimum(at[alive] + k, len(q.text) - 1)] == ids[np.minimum(place[alive] + k, len(ids) - 1)])
        alive = alive[same]
        length[alive] += 1
    return length


def scan(chunk: Words, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: which words are hit; (document, item) pairs; left-maximal matches (document, item, item word, document word, length)."""
    n = len(chunk.hash)
    none = np.zeros(n, bool), np.empty((0, 2), np.int64), np.empty((0, 5), np.int64)
    if not n:
        return none
    shortest = int(q.length.min())
    ids, run = corpus_ids(chunk, q, shortest)
    sa = suffix_array(ids, run, shortest, int(q.left.max()))
    if not len(sa):
        return none
    low, high = search(sa, ids, run, q)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return none
    count = high[hit] - low[hit]
    place, window = sa[ranges(low[hit], count)], np.repeat(hit, count)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + q.length[window], -1)
    covered = np.cumsum(edge)[:n] > 0
    doc = chunk.row_of(place)
    times = q.by[window + 1] - q.by[window]
    at = q.at[ranges(q.by[window], times)]
    place, doc = np.repeat(place, times), np.repeat(doc, times)
    pairs = np.unique(np.stack([doc, q.item[at]], axis=1), axis=0)
    before = (at > q.item_start[at]) & (place > chunk.rows[doc])
    maximal = ~(before & (q.text[np.maximum(at - 1, 0)] == ids[np.maximum(place - 1, 0)]))
    at, place, doc = at[maximal], place[maximal], doc[maximal]
    matches = np.stack([doc, q.item[at], at - q.item_start[at], place - chunk.rows[doc], longest(ids, run, q, at, place)], axis=1)
    return covered, pairs, matches


def digest(ids: set) -> str:
    return hashlib.sha256(",".join(sorted("" if i is None else str(i) for i in ids)).encode()).hexdigest()


def judge(text: pa.Array, blocks: list[Queries]) -> dict[str, list]:
    """The columns of FOUND for one batch of texts."""
    out: dict[str, list] = {f.name: [] for f in FOUND.fields}
    for chunk in words(text, ALNUM_LOWER, SHARD_BYTES):
        covered = np.zeros(len(chunk.hash), bool)
        items: dict[int, set] = {}
        matches: dict[int, list] = {}
        for q in blocks:
            own, pairs, found = scan(chunk, q)
            covered |= own
            for d, i in pairs.tolist():
                items.setdefault(d, set()).add(q.ids[i])
            for d, i, a, p, k in found.tolist():
                matches.setdefault(d, []).append({"item_id": q.ids[i], "item_word": a, "doc_word": p, "n_words": k})
        n_hit = row_sums(covered, chunk.rows).tolist()
        none = digest(set())
        out["n_words"] += np.diff(chunk.rows).tolist()
        out["n_hit"] += n_hit
        out["n_items"] += [len(items.get(d, ())) for d in range(chunk.n)]
        out["items_sha256"] += [digest(items[d]) if d in items else none for d in range(chunk.n)]
        out["longest_match"] += [max((m["n_words"] for m in matches.get(d, ())), default=0) for d in range(chunk.n)]
        out["matches"] += [sorted(matches.get(d, ()), key=lambda m: (m["doc_word"], str(m["item_id"]), m["item_word"])) for d in range(chunk.n)]
        out["contaminated"] += [k > 0 for k in n_hit]
    return out


ARROW_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))
ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(),
         "longest_match": pa.int64(), "matches": ARROW_MATCHES, "contaminated": pa.bool_()}


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """The benchmark as broadcasts of bounded size, each a list of (item_id, text) rows."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = int(-(-total // block_bytes))
    part = rows.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1))))
    return [spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.where(F.col("_b") == b).collect()]) for b in range(n)]


def gathered(batches: Iterator[pa.RecordBatch], least: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``least`` bytes or more, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: a struct ``row`` of the columns ``keep`` and a struct ``found`` (FOUND)."""
    blocks = benchmark_blocks(benchmark, block_bytes)
    source = docs.select(F.struct(*keep).alias("row"), "text")
    schema = T.StructType([source.schema["row"], T.StructField("found", FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [prepare(b.value, window) for b in blocks] if len(blocks) == 1 else None
        for batch in batches if whole is not None else gathered(batches):
            queries = whole if whole is not None else (prepare(b.value, window) for b in blocks)
            got = judge(batch.column(1), [q for q in queries if q is not None])
            found = pa.StructArray.from_arrays([pa.array(got[k], t) for k, t in ARROW.items()], names=list(ARROW))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=schema.names)

    return map_texts(source, run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any benchmark item, with all their columns."""
    return contamination(docs, benchmark, docs.columns, window).where(~F.col("found.contaminated")).select("row.*")
