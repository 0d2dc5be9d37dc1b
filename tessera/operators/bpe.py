"""Byte-level BPE, trained in exact order and applied to distinct words.

Training. Texts become distinct words with counts (partial aggregation, one
shuffle), and words stay in Spark, as blocks of flat arrays of ids that NumPy
works on. A round goes so:

1. A job counts the pairs of neighbouring symbols, and the most frequent come to the driver.
2. Some of the first are chosen. Words are cut wherever a pair is none of these,
   and equal pieces are added up, so few distinct pieces stand for very many
   words; they come to the driver, at most ``sample_words``.
3. The driver learns merges on the pieces as long as the best pair (ties: the
   smaller ids) has a higher count than every pair that was not chosen.

That is exact: what a symbol made in this round begins and ends with is the same
wherever it stands, so a pair of two symbols is cut nowhere or everywhere, and one
that is cut everywhere has at most the count of the pair cut at first. That needs
every symbol to be made by one merge, so a round ends after a merge whose symbol
there is already. No merge is guessed and none undone. Words are stored anew after
``STORED_AFTER`` merges, so a job applies the last ones only.

Encoding. The merges go to every worker, which encodes each distinct word of an
Arrow batch once and keeps it; no token is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import materialise

#: fixed values: what the byte-level splitter takes as one word, and the characters that every vocabulary holds
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
INITIAL_ALPHABET = "0123456789.,+-*/=()%"

SAMPLE_WORDS = 1 << 17
#: symbols of pieces that come to the driver, pairs with their counts that do, and symbols of words in a block
HELD_SYMBOLS, TOP_PAIRS, BLOCK_SYMBOLS = 1 << 19, 1 << 15, 1 << 20
STORED_AFTER = 256
KEPT_WORDS = 1 << 20

Pair = tuple[str, str]


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is seen, else one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in seen else spare))
        spare += b not in seen
    return out


def byte_words(c: Column, specials=()) -> Column:
    """Words of the byte-level splitter; specials stand whole and part a text, and a space goes before each part that has none."""
    marks = "|".join(s.replace("[", r"\[").replace("]", r"\]") for s in specials)
    if not marks:
        spaced = F.regexp_replace(T.clean_text(c), "^(?! |$)", " ")
        return F.regexp_extract_all(spaced, F.lit("(?U)" + BYTE_LEVEL_PATTERN), F.lit(0))
    spaced = F.regexp_replace(T.clean_text(c), f"(^|{marks})(?! |$|{marks})", "$1 ")
    # no word reaches into a special, and blanks before one are at the end of their part
    inside = BYTE_LEVEL_PATTERN.replace(r"[^\s\p{L}\p{N}]+", rf"(?:(?!{marks})[^\s\p{{L}}\p{{N}}])+").replace(r"(?!\S)", rf"(?!(?!{marks})\S)")
    return F.regexp_extract_all(spaced, F.lit(f"(?U){marks}|{inside}"), F.lit(0))


def merged(symbols: list[str], left: str, right: str) -> list[str]:
    """Every non-overlapping (left, right), from the left, as one symbol."""
    out, i, n = [], 0, len(symbols)
    while i < n:
        if i + 1 < n and symbols[i] == left and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def pairs_of(symbols: list[str]) -> Iterator[Pair]:
    return zip(symbols, symbols[1:], strict=False)


def steps(symbols: list[str], rank: dict[Pair, int]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(rank, before, after) of each merge that a word goes through, in order."""
    while found := [(rank[p], p) for p in pairs_of(symbols) if p in rank]:
        r, pair = min(found)
        after = merged(symbols, *pair)
        yield r, symbols, after
        symbols = after


def split_by_merges(symbols: list[str], rank: dict[Pair, int]) -> list[str]:
    for _, _, symbols in steps(symbols, rank):  # noqa: B020
        pass
    return symbols


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | right


def summed(keys: pa.Array | np.ndarray, n: np.ndarray) -> pa.Table:
    """(key, n): ``n`` added up for each distinct key."""
    found = pa.table({"key": keys, "n": n}).group_by("key", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"key": found["key"], "n": found["n_sum"]})


def without_overlaps(at: np.ndarray) -> np.ndarray:
    """Places of one pair (sorted) that a merge from the left takes: every other one in a row, as in 'aaa'."""
    if not len(at):
        return at
    first = np.concatenate([[True], np.diff(at) != 1])
    number = np.arange(len(at))
    return at[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]


class HeldPieces:
    """Pieces of words under the merges so far: their pairs' counts, and the pair with the highest one (ties: the smaller ids)."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        """``symbols``: pieces one after the other, -1 behind each; ``freq`` of the piece that each place is in."""
        self.symbols, self.freq = symbols, freq
        self.counts: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []
        self._change(np.arange(len(symbols) - 1), 1)

    def _change(self, at: np.ndarray, sign: int) -> None:
        """Count the pairs that begin at ``at``, or take them out."""
        left, right = self.symbols[at], self.symbols[at + 1]
        ok = (left >= 0) & (right >= 0)
        for key, n in zip(*(c.to_pylist() for c in summed(pair_keys(left[ok], right[ok]), self.freq[at[ok]]).columns), strict=True):
            n = self.counts[key] = self.counts.get(key, 0) + sign * n
            if n:
                heapq.heappush(self.heap, (-n, key))  # a key's order is that of the ids
            else:
                del self.counts[key]

    def best(self, above: int) -> tuple[int, int, int] | None:
        """(left, right, count), if the count is over ``above``."""
        while self.heap:
            n, key = self.heap[0]
            if -n == self.counts.get(key, 0):
                return (key >> 32, key & 0xFFFFFFFF, -n) if -n > above else None
            heapq.heappop(self.heap)
        return None

    def merge(self, left: int, right: int, made: int) -> None:
        at = np.flatnonzero((self.symbols[:-1] == left) & (self.symbols[1:] == right))
        at = without_overlaps(at) if left == right else at
        around = np.unique(np.concatenate([at - 1, at, at + 1]))
        self._change(around[(around >= 0) & (around < len(self.symbols) - 1)], -1)
        self.symbols[at] = made
        self.symbols, self.freq = np.delete(self.symbols, at + 1), np.delete(self.freq, at + 1)
        at = at - np.arange(len(at))
        around = np.unique(np.concatenate([at - 1, at]))
        self._change(around[around >= 0], 1)


@dataclass
class Bpe:
    """A trained vocabulary: ids of tokens (specials, alphabet, merged symbols) and merges with their counts when learned."""

    ids: dict[str, int]
    merges: list[tuple[str, str, int]]
    specials: list[str]

    def merges_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, a, b, n) for k, (a, b, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string, count long")

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, t) for t, i in self.ids.items()], "id int, token string")


def save_bpe(spark: SparkSession, bpe: Bpe, path: str) -> None:
    """X12 (save side): vocabulary and merges as tables under ``path``."""
    bpe.vocab_table(spark).withColumn("special", F.col("token").isin(*bpe.specials)).write.mode("overwrite").parquet(f"{path}/vocab")
    bpe.merges_table(spark).write.mode("overwrite").parquet(f"{path}/merges")


def load_bpe(spark: SparkSession, path: str) -> Bpe:
    """Reuse saved byte pairs; as many rows as the vocabulary has come to the driver, as in training."""
    vocab = spark.read.schema("id int, token string, special boolean").parquet(f"{path}/vocab").orderBy("id").collect()
    merges = spark.read.schema("rank int, left string, right string, count long").parquet(f"{path}/merges").orderBy("rank").collect()
    return Bpe({r.token: r.id for r in vocab}, [(r.left, r.right, r["count"]) for r in merges], [r.token for r in vocab if r.special])


def word_counts(corpus: DataFrame, text_col: str = "text", specials=()) -> DataFrame:
    """(word, freq): distinct words of the byte-level splitter."""
    words = corpus.select(F.explode(byte_words(F.col(text_col), specials)).alias("word"))
    if specials:
        words = words.where(~F.col("word").isin(*specials))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _blocks(words: DataFrame) -> DataFrame:
    """(symbols, freq): blocks of words as int32 arrays of bytes, -1 behind each word, and int64 arrays of their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, freq, n = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()]), pa.array([np.concatenate(freq).tobytes()])], names=["symbols", "freq"])

        for batch in batches:
            words = batch.column(0).cast(pa.binary()).to_pylist()
            size = np.fromiter(map(len, words), np.int64, len(words))
            symbols = np.full(int(size.sum()) + len(words), -1, np.int32)
            symbols[np.arange(int(size.sum())) + np.repeat(np.arange(len(words)), size)] = np.frombuffer(b"".join(words), np.uint8)
            held.append(symbols)
            freq.append(batch.column(1).to_numpy().astype(np.int64))
            n += len(symbols)
            if n >= BLOCK_SYMBOLS:
                yield block()
                held, freq, n = [], [], 0
        if held:
            yield block()

    return words.mapInArrow(run, "symbols binary, freq binary")


def word_numbers(symbols: np.ndarray) -> np.ndarray:
    """The number of the word that each place, also the -1 behind a word, is in."""
    ends = symbols < 0
    return np.cumsum(ends) - ends


def replayed(symbols: np.ndarray, freq: np.ndarray, merges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block (its words in another order) after ``merges``: rows (left, right, made) in the order they were learned."""
    if not len(merges) or not len(freq):
        return symbols, freq
    keys = pair_keys(merges[:, 0], merges[:, 1])
    order = np.argsort(keys)
    keys = keys[order]
    size = max(int(symbols.max(initial=0)), int(merges.max())) + 2  # the last entry is for -1
    begins, ends = np.zeros(size, bool), np.zeros(size, bool)
    begins[merges[:, 0]] = ends[merges[:, 1]] = True
    done = np.full(len(freq), -1)  # of each word: a merge isn't applied once a later one has been
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(freq):
        at = np.flatnonzero(begins[symbols[:-1]] & ends[symbols[1:]])
        own = pair_keys(symbols[at], symbols[at + 1])
        found = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        word = word_numbers(symbols)
        rank = order[found]
        hit = (keys[found] == own) & (rank > done[word[at]])
        at, rank = at[hit], rank[hit]
        first = np.flatnonzero(np.diff(word[at], prepend=-1))  # of each word that holds a pair
        least = np.minimum.reduceat(rank, first) if len(first) else rank
        going = np.zeros(len(freq), bool)
        going[word[at[first]]] = True
        done[word[at[first]]] = least
        now = rank == np.repeat(least, np.diff(np.append(first, len(at))))
        at, rank = at[now], rank[now]
        taken = without_overlaps(at)  # places that overlap are of one pair
        rank = rank[np.searchsorted(at, taken)]
        symbols[taken] = merges[rank, 2]
        kept = np.ones(len(symbols), bool)
        kept[taken + 1] = False
        stays = kept & ~going[word]
        out.append((symbols[stays], freq[~going]))
        symbols, freq, done = symbols[kept & going[word]], freq[going], done[going]
    return np.concatenate([s for s, _ in out]), np.concatenate([f for _, f in out])


class Words:
    """Distinct words in Spark: blocks, what ids their numbers stand for, and the merges learned since they were stored."""

    def __init__(self, blocks: DataFrame, whole: bool):
        self.blocks, self.whole = blocks, whole  # whole: in one partition
        self.ids: np.ndarray | None = None
        self.last: list[tuple[int, int, int]] = []

    def _mapped(self, make, schema: str) -> DataFrame:
        """What ``make`` gives (columns of a batch) of each block (symbols, counts of its words) as it is now."""
        shared = self.blocks.sparkSession.sparkContext.broadcast((self.ids, np.array(self.last, np.int32).reshape(-1, 3)))
        names = [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, merges = shared.value
            for batch in batches:
                for symbols, freq in zip(batch.column(0), batch.column(1), strict=True):
                    symbols, freq = np.frombuffer(symbols.as_buffer(), np.int32), np.frombuffer(freq.as_buffer(), np.int64)
                    yield pa.RecordBatch.from_arrays(make(*replayed(symbols.copy() if ids is None else ids[symbols], freq, merges)), names=names)

        out = self.blocks.mapInArrow(run, schema)
        return out.coalesce(1) if self.whole else out

    def letters(self) -> list[int]:
        """Bytes that occur, 256 at most."""
        return [r.b for r in self._mapped(lambda symbols, freq: [pa.array(np.unique(symbols[symbols >= 0]))], "b int").distinct().collect()]

    def store(self) -> None:
        """Words as they are now, without those of one symbol."""
        def make(symbols, freq):
            word = word_numbers(symbols)
            long = np.bincount(word, minlength=len(freq)) > 2
            return [pa.array([symbols[long[word]].astype(np.int32).tobytes()]), pa.array([freq[long].tobytes()])]

        self.blocks = materialise(self._mapped(make, "symbols binary, freq binary"), cache=True)
        self.ids, self.last = None, []

    def pairs(self, min_freq: int) -> list[tuple[int, int, int]]:
        """(left, right, count) of the pairs with the highest counts in order, ``TOP_PAIRS`` at most."""
        def make(symbols, freq):
            at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
            found = summed(pair_keys(symbols[at], symbols[at + 1]), freq[word_numbers(symbols)[at]])
            return [c.combine_chunks() for c in found.columns]

        found = self._mapped(make, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_freq)
        rows = found.orderBy(F.col("n").desc(), "key").limit(TOP_PAIRS).toArrow()
        return [(k >> 32, k & 0xFFFFFFFF, n) for k, n in zip(rows["key"].to_pylist(), rows["n"].to_pylist(), strict=True)]

    def pieces(self, known: list[tuple[int, int, int]], most: int) -> HeldPieces | None:
        """Words cut at every pair that isn't among ``known``, equal pieces as one; None if there are more than the driver takes."""
        shared = self.blocks.sparkSession.sparkContext.broadcast(np.sort(pair_keys(*np.array(known, np.int64)[:, :2].T)))

        def make(symbols, freq):
            keys = shared.value
            at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
            own = pair_keys(symbols[at], symbols[at + 1])
            joined = np.zeros(len(symbols) + 1, bool)  # place i with the one before it
            joined[at[keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own] + 1] = True
            held = joined[:-1] | joined[1:]
            begin = np.flatnonzero(~joined[:-1][held])
            flat = symbols[held].astype(np.int32)
            ends = np.append(begin, len(flat)).astype(np.int32) * 4
            cut = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            found = summed(cut, freq[word_numbers(symbols)[held][begin]])
            return [c.combine_chunks() for c in found.columns]

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows, size = [], 0, 0
            for batch in batches:
                rows, size = rows + len(batch), size + batch.column(0).nbytes // 4
                if rows > most or size > HELD_SYMBOLS:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0])], names=["key", "n"])
                    return
                held.append(batch)
            yield from held

        found = self._mapped(make, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
        rows = found.limit(min(most, HELD_SYMBOLS) + 1).mapInArrow(bounded, "key binary, n long").toArrow()
        if rows["key"].null_count:
            return None
        texts = rows["key"].to_pylist()
        size = np.fromiter((len(t) // 4 + 1 for t in texts), np.int64, len(texts))
        return HeldPieces(np.frombuffer(b"".join(t + b"\xff\xff\xff\xff" for t in texts), np.int32).copy(), np.repeat(rows["n"].to_numpy(), size))


def _words(corpus: DataFrame, text_col: str, specials) -> Words:
    found = word_counts(corpus, text_col, specials).persist()
    size = found.agg(F.sum(F.octet_length("word") + F.lit(1))).first()[0] or 0
    parts = max(1, -(-size // BLOCK_SYMBOLS))  # every round works on all words
    blocks = materialise(_blocks(found.repartition(parts, "word") if parts > 1 else found.coalesce(1)), cache=True)
    found.unpersist()
    return Words(blocks, parts == 1)


def train_bpe(corpus: DataFrame, vocab_size: int = 8000, min_freq: int = 2, text_col: str = "text", specials=tuple(T.QA_SPECIALS),
              alphabet: str = INITIAL_ALPHABET, batch: int = 1024, sample_words: int = SAMPLE_WORDS, max_merges: int | None = None) -> Bpe:
    """Learn merges until the vocabulary has ``vocab_size`` tokens, no pair is found ``min_freq`` times, or there are ``max_merges``.

    ``sample_words``: distinct pieces of words that the driver takes; ``batch``: merges of a round at most.
    """
    words = _words(corpus, text_col, specials)
    chars = byte_characters()
    letters = sorted({chars[b] for b in words.letters()} | set(alphabet))
    ids: dict[str, int] = {t: k for k, t in enumerate([*specials, *letters])}
    tokens = {i: t for t, i in ids.items()}
    words.ids = np.array([*(ids.get(c, -1) for c in chars), -1], np.int32)  # -1 stays

    merges: list[tuple[str, str, int]] = []
    least = max(min_freq, 1)
    share = 0.5  # of the highest count: pairs down to it are chosen

    def more() -> bool:
        return len(ids) < vocab_size and (max_merges is None or len(merges) < max_merges)

    while more() and (top := words.pairs(least)):
        if len(words.last) >= STORED_AFTER or top[0][:2] in {m[:2] for m in words.last}:  # a pair that is found anew has two places in the order
            words.store()
        full = len(top) == TOP_PAIRS  # others may have the count of the last
        n = sum(c > top[0][2] * share for *_, c in top[:len(top) - full])
        n, held = max(1, min(n, sample_words)), None
        while n > 1 and (held := words.pieces(top[:n], sample_words)) is None:
            n //= 2
        above = max(least - 1, top[n][2] if n < len(top) else 0)
        share = min(0.8 * max(share, above / top[0][2]) if n < len(top) else share, 0.9)
        pair, end, again = top[0], len(merges) + batch, {m[:2] for m in words.last}
        while pair and pair[:2] not in again:
            left, right, count = pair
            token = tokens[left] + tokens[right]
            merges.append((tokens[left], tokens[right], count))
            known = token in ids
            made = ids.setdefault(token, len(ids))
            tokens[made] = token
            words.last.append((left, right, made))
            if held is None or known or len(merges) >= end or not more():  # a pair alone comes without pieces
                break
            held.merge(left, right, made)
            pair = held.best(above)
    return Bpe(ids, merges, list(specials))


def encode_bpe(df: DataFrame, key: list[str], text_col: str, bpe: Bpe, out_col: str = "ids", unk_token: str = "[UNK]") -> DataFrame:
    """Ids of each row's text; a byte that the vocabulary lacks is the unknown token. Null text has none."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((bpe.ids, {(a, b): k for k, (a, b, _) in enumerate(bpe.merges)}, set(bpe.specials)))
    words = df.select(*key, byte_words(F.col(text_col), bpe.specials).alias("_words"))
    schema = df.select(*key, F.array(F.lit(0)).alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rank, specials = shared.value
        chars, known = byte_characters(), {}
        unk = ids.get(unk_token)

        def encoded(word: str) -> list[int]:
            if word in specials:
                return [ids[word]]
            out = [ids.get(s, unk) for s in split_by_merges([chars[b] for b in word.encode()], rank)]
            if None in out:
                raise ValueError(f"byte without a token and no unknown token: {word!r}")
            return out

        for batch in batches:
            lists = batch.column(len(key))
            flat = lists.flatten().dictionary_encode()
            if len(known) > KEPT_WORDS:
                known.clear()
            distinct = [known[w] if w in known else known.setdefault(w, encoded(w)) for w in flat.dictionary.to_pylist()]
            size = np.fromiter(map(len, distinct), np.int64, len(distinct))
            begin = np.cumsum(size) - size
            every = np.fromiter((i for x in distinct for i in x), np.int32, int(size.sum()))
            at = flat.indices.to_numpy()
            n = size[at]
            before = np.concatenate([[0], np.cumsum(n)])
            out = every[np.repeat(begin[at] - before[:-1], n) + np.arange(int(n.sum()))]
            rows = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(key))), pa.ListArray.from_arrays(pa.array(before[rows].astype(np.int32)), pa.array(out))], names=schema.names)

    return words.mapInArrow(run, schema)
