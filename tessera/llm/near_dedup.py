"""Near-duplicate documents by MinHash samples folded into odd sketches.

1. Each document becomes a set of hashed word shingles, a 126-bit digest of that
   set (its class: documents with equal sets), MinHash samples in bands, and an
   odd sketch: a bitmap in which each sample flips one bit. Two sketches' XOR
   then counts the samples that differ, so its population count estimates a
   high similarity precisely.
2. Classes that share a band meet. In every bucket the class that meets most
   others over all its bands is the pivot and is paired with each other member:
   a bucket of m classes makes m - 1 pairs, however large it is. In a group of
   edited copies that is the copy nearest to all.
3. Pairs whose XOR count or set sizes rule out a link are dropped, and the rest
   confirmed on full sets.
4. Links are joined to components. A star (a pivot and what it meets) that
   still holds more than one component may hide a link between two members that
   the pivot doesn't join. What sets members apart from their pivot tells which
   pairs can be linked (``differences``): those that share enough of the
   shingles that the pivot lacks or alone has. They meet on the rarest of these,
   so the bulk of a large group of copies with edits of their own never meets.
   Pairs that sizes and sketches allow too are confirmed on full sets, the
   nearest of two components first; components that a link joins need no more.
   No link between components is lost.
5. Every document gets the least doc_id of its component.

Bands are of 5 samples, as many as it takes to miss a pair at the threshold
with a probability of at most 5e-7 (25 for 0.85, 37 for 0.8). The XOR limit of 400 samples lies 4.5 standard deviations above the
expected count at the threshold (3.4e-6). Sets are sets of 64-bit hashes.

Defined cases: null text and text without words have an empty set, are linked
with nothing and form a component of their own; rows with equal text, or the
same doc_id and text, are one class; a null doc_id counts only where a
component has no other id, and its component id is then null; rows that share
doc_id and text are all kept by the query, and one of them by ``deduplicated``;
empty input gives no rows. Other columns are neither read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.components import components
from tessera.llm.tables import map_texts, scratch, stored
from tessera.llm.words import SPACED_LOWER, Words, mix, words

ROWS, MISS = 5, 5e-7
SAMPLES, BITS, DEVIATIONS = 400, 2048, 4.5
SLOTS = 1 << 20
#: rows whose sketches are made at once: a row's counts take 16 KB
SKETCHED = 256
#: pairs of two components that are tested in the first round
TESTED = 4
CLASS = T.DecimalType(38, 0)


def shingles(chunk: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, one row after the other; and their row offsets."""
    h, rows = chunk.hash, chunk.rows
    n_words = np.diff(rows)
    parts, sizes = [], np.zeros(chunk.n, np.int64)
    n = len(h)
    if n >= width:
        full = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            full = mix(full ^ h[k:n - width + 1 + k], k + 2)
    for d in np.flatnonzero(n_words).tolist():
        a, b = rows[d], rows[d + 1]
        if b - a >= width:
            own = np.sort(full[a:b - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:  # the whole sequence; its length keeps it apart from longer ones
            own = np.zeros(1, np.uint64)
            for k in range(a, b):
                own = mix(own ^ h[k:k + 1], int(k - a) + 2)
            own = mix(own, 100 + int(b - a))
        parts.append(own)
        sizes[d] = len(own)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def digests(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Order-free digest of each non-empty set, as 16 little-endian bytes below 10^38."""
    out = np.zeros((len(offs) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        out[full, 0] = mix(np.add.reduceat(mix(sets, 41), offs[:-1][full]), 43)
        out[full, 1] = mix(np.add.reduceat(mix(sets, 47), offs[:-1][full]) + np.diff(offs)[full].astype(np.uint64), 53) >> np.uint64(3)
    return out


def decimals(pairs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(pairs), [None, pa.py_buffer(np.ascontiguousarray(pairs).tobytes())])


def samples(sets: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash samples of each set; rows of empty sets hold zeros."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.zeros((len(offs) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    step = 1 << 15
    i = 0
    while i < len(full):  # runs of sets that fit the cache
        j = max(i + 1, int(np.searchsorted(offs[1:][full], offs[full[i]] + step, side="right")))
        own = sets[offs[full[i]]:offs[full[j - 1] + 1]]
        start = offs[full[i:j]] - offs[full[i]]
        for k in range(n):
            out[full[i:j], k] = np.minimum.reduceat(own * a[k] + b[k], start)
        i = j
    return out


def bands(minima: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One key for each band of samples."""
    keys = np.zeros((len(minima), n_bands), np.uint64)
    keys += np.arange(n_bands, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys ^ minima[:, k:n_bands * rows:rows], 60 + k)
    return keys


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity ** ROWS))


def odd_sketch(minima: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: sample i with value x flips the bit that (i, x) hashes to."""
    parts = []
    for first in range(0, max(len(minima), 1), SKETCHED):
        part = minima[first:first + SKETCHED]
        m, n = part.shape
        where = (mix(part + np.arange(n, dtype=np.uint64), 71) % np.uint64(bits)).astype(np.int64) + (np.arange(m) * bits)[:, None]
        odd = (np.bincount(where.reshape(-1), minlength=m * bits) & 1).astype(np.uint8).reshape(m, bits)
        parts.append(np.packbits(odd, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(parts)


def least_similarity(similarity: float, n: int) -> float:
    """Share of equal samples that a pair at the threshold goes below by ``DEVIATIONS`` only."""
    return similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / n)


def xor_limit(similarity: float, n: int, bits: int) -> int:
    """Largest XOR count of a pair at the threshold, within the deviations of samples and of the folding."""
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * n * (1 - least_similarity(similarity, n))))
    return math.ceil(expected + math.sqrt(expected))


def longs(table: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(table).view(np.int64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * np.int32(table.shape[1])), flat)


def signatures(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, bands, sketch) of each row; cls null for an empty set."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("cls", CLASS),
                           T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])

    n_bands = bands_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words(batch.column(2), SPACED_LOWER):
                sets, offs = shingles(chunk, width)
                size = np.diff(offs)
                minima = samples(sets, offs, SAMPLES)
                cls = pc.if_else(pa.array(size > 0), decimals(digests(sets, offs)), pa.scalar(None, pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(chunk.first, chunk.n) for i in range(2)), pa.array(size), cls, longs(bands(minima, n_bands, ROWS)), longs(odd_sketch(minima, BITS))],
                    names=schema.names)

    return map_texts(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run, schema)


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(cls, members) of rows (cls, text); rows whose text is of another class are left out."""
    schema = T.StructType([T.StructField("cls", CLASS), T.StructField("members", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words(batch.column(1), SPACED_LOWER):
                sets, offs = shingles(chunk, width)
                own = decimals(digests(sets, offs))
                same = pc.equal(batch.column(0).slice(chunk.first, chunk.n), own)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(sets.view(np.int64)))], names=schema.names).filter(same)

    return map_texts(texts.select("cls", "text"), run, schema)


def xor_count(a: str, b: str) -> Column:
    return F.expr("+".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(BITS // 64)))


def may_link(percent: int, a: str, b: str) -> Column:
    """Set sizes and sketches allow a link of ``percent`` or more."""
    sizes = F.expr(f"100 * least(n_{a}, n_{b}) >= {percent} * greatest(n_{a}, n_{b})")
    return sizes & (xor_count(f"s_{a}", f"s_{b}") <= xor_limit(percent / 100, SAMPLES, BITS))


def number_of(doc_id: str | Column) -> Column:
    """One of ``SLOTS`` numbers, so that a set of them is a broadcast of bounded size."""
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS))


def class_sets(wanted: DataFrame, reps: DataFrame, docs: DataFrame, width: int, name: str) -> DataFrame:
    """(cls, members): the full sets of the classes in ``wanted``, stored."""
    wanted = stored(wanted.distinct().join(reps.select("cls", "min_doc"), "cls"), f"{name}-wanted")
    # texts that can't be wanted don't leave their scan: a broadcast of at most SLOTS numbers
    numbers = F.broadcast(wanted.select(number_of("min_doc").alias("number")).distinct())
    texts = docs.select("doc_id", "text", number_of("doc_id").alias("number")).join(numbers, "number", "left_semi")
    texts = wanted.join(texts, F.col("min_doc").eqNullSafe(F.col("doc_id")))
    return stored(full_sets(texts, width).dropDuplicates(["cls"]), f"{name}-sets")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs of classes whose full sets are linked."""
    a = sets.select(F.col("cls").alias("a"), F.col("members").alias("m_a"))
    b = sets.select(F.col("cls").alias("b"), F.col("members").alias("m_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("m_a", "m_b")))
    return both.where(f"100 * common >= {percent} * (size(m_a) + size(m_b) - common)").select("a", "b")


def with_roots(rows: DataFrame, label: DataFrame, *names: str) -> DataFrame:
    """Add ``r_<name>``, the root of each named class; a class without links is its own root."""
    for c in names:
        own = label.select(F.col("v").alias(f"_v_{c}"), F.col("root").alias(f"_r_{c}"))
        rows = rows.join(own, F.col(c) == F.col(f"_v_{c}"), "left").withColumn(f"r_{c}", F.coalesce(f"_r_{c}", c)).drop(f"_v_{c}", f"_r_{c}")
    return rows


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links (a, b) between roots are added."""
    step = components(links)
    new = step.select(F.col("v").alias("_v"), F.col("root").alias("_root"))
    moved = label.join(new, label["root"] == new["_v"], "left").select("v", F.coalesce("_root", "root").alias("root"))
    return stored(moved.unionByName(step.join(label.select("v"), "v", "left_anti")), "labels")


def differences(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(pivot, cls, root, outside, w, slack, e, left): what sets apart each member of an open star from its pivot.

    Let D be the shingles that a member and the pivot don't share. For members
    x and y the common part of D_x and D_y is |x & y| - |p| + |p - x| + |p - y|,
    so they are linked if and only if it has at least
    (w_x + w_y - slack) / (100 + percent) elements, with
    w = 100 |p - x| + percent |x - p| and slack = (100 - percent) |p|.
    Elements of D are put in order, the rarest of the star first; ``left``
    counts those from here on, itself included. The first element that two
    linked members share, in that order, has at least as many left on either
    side. Elements that no other member has are dropped after counting.
    """
    own = star.join(sets.select(F.col("cls").alias("pivot"), F.col("members").alias("p")), "pivot").join(sets, "cls")
    own = own.withColumn("gone", F.array_except("p", "members")).withColumn("new", F.array_except("members", "p"))
    own = own.select("pivot", "cls", "root", "outside", F.expr(f"100L * size(gone) + {percent}L * size(new)").alias("w"),
                     F.expr(f"{100 - percent}L * size(p)").alias("slack"), F.concat("gone", "new").alias("d"))
    own = stored(own, "differences")
    each = own.select("pivot", "cls", F.explode("d").alias("e"))
    often = each.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = Window.partitionBy("pivot", "cls").orderBy(F.col("often").desc(), "e")  # from the last to the first
    rest = each.join(often, ["pivot", "e"]).withColumn("left", F.row_number().over(order)).select("pivot", "cls", "e", "left")
    return rest.join(own.drop("d"), ["pivot", "cls"])


def hidden_pairs(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of one star and of two components that their differences from the pivot allow to be linked.

    At least one of them is outside the pivot's component. Copies with edits of
    their own share none of the rare shingles that those bring, so they don't
    meet here, however many they are.
    """
    rows = differences(star, sets, percent)
    least = stored(rows, "elements")
    bound = least.groupBy("pivot").agg(F.min("w").alias("w_any"), F.min(F.when(F.col("outside"), F.col("w"))).alias("w_out"))
    rows = least.join(bound, "pivot")
    reach = F.expr(f"{100 + percent}L * left + slack - w")  # the greatest w of a partner whose first common element this is
    x = rows.where("outside").where(reach >= F.col("w_any")).select("pivot", "e", F.col("cls").alias("x"), F.col("root").alias("r_x"), F.col("w").alias("w_x"), reach.alias("reach_x"))
    y = rows.where(reach >= F.col("w_out")).select("pivot", "e", F.col("cls").alias("y"), F.col("root").alias("r_y"), F.col("w").alias("w_y"), reach.alias("reach_y"))
    # an element of one component joins nothing
    several = x.select("pivot", "e", F.col("r_x").alias("r")).unionByName(y.select("pivot", "e", F.col("r_y").alias("r"))).groupBy("pivot", "e").agg(
        F.min("r").alias("r0"), F.max("r").alias("r1")).where("r0 <> r1").select("pivot", "e")
    met = x.join(several, ["pivot", "e"]).join(y, ["pivot", "e"]).where("r_x <> r_y and w_x <= reach_y and w_y <= reach_x")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key), one row per row of ``docs``; text_key hashes the text."""
    with scratch(docs.sparkSession, "near-dedup"):
        return stored(_near_duplicates(docs, width, percent), "near-duplicates", keep=True)


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    sig = stored(signatures(docs, width, percent / 100), "signatures")
    reps = stored(sig.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("min_doc"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    members = reps.select("cls", F.explode("bands").alias("band"))
    sizes = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    met = stored(members.join(sizes, "band"), "met")
    score = met.groupBy("cls").agg(F.sum("size").alias("score"))
    scored = stored(met.join(score, "cls"), "scored")
    pivots = scored.groupBy("band").agg(F.max(F.struct("score", "cls")).alias("p")).select("band", F.col("p.cls").alias("pivot"))
    star = stored(scored.join(pivots, "band").where("cls <> pivot").select("pivot", "cls").distinct(), "stars")

    signs = reps.select("cls", "n", "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(signs.select(*[F.col(c).alias(f"{c[0]}_{side}") for c in ("n", "sketch")], F.col("cls").alias(side)), side)
        return pairs.where(may_link(percent, "a", "b")).select("a", "b", xor_count("s_a", "s_b").alias("apart"))

    first = stored(likely(star.select(F.col("pivot").alias("a"), F.col("cls").alias("b"))), "pivot-pairs")
    sets = class_sets(first.select(F.col("a").alias("cls")).union(first.select(F.col("b").alias("cls"))), reps, docs, width, "pivots")
    label = components(compared(first, sets, percent))

    # stars of two members or more, of which one is outside the pivot's component
    rooted = with_roots(star, label, "cls", "pivot").withColumn("outside", F.col("r_cls") != F.col("r_pivot"))
    rooted = stored(rooted.select("pivot", "cls", F.col("r_cls").alias("root"), "outside"), "rooted-stars")
    open_ = rooted.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("outside").alias("any")).where("n > 1 and any").select("pivot")
    star = stored(rooted.join(open_, "pivot"), "open-stars")
    if star.limit(1).count():
        sets = class_sets(star.select("cls").union(star.select(F.col("pivot").alias("cls"))), reps, docs, width, "open")
        todo = stored(likely(hidden_pairs(star, sets, percent)), "hidden-pairs")
        tested = TESTED
        while True:  # the nearest pairs of two components first: where they are linked, the others needn't be tested
            todo = stored(with_roots(todo.select("a", "b", "apart"), label, "a", "b").where("r_a <> r_b"), "untested-pairs")
            if not todo.limit(1).count():
                break
            ends = (F.least("r_a", "r_b"), F.greatest("r_a", "r_b"))
            todo = stored(todo.withColumn("_rank", F.row_number().over(Window.partitionBy(*ends).orderBy("apart", "a", "b"))), "ranked-pairs")
            found = compared(todo.where(F.col("_rank") <= tested), sets, percent)
            links = stored(with_roots(found, label, "a", "b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).distinct(), "hidden-links")
            if links.limit(1).count():
                label = merged(label, links)
            todo = todo.where(F.col("_rank") > tested)
            tested *= 16

    grouped = label.join(reps.select("cls", "min_doc"), label["v"] == F.col("cls"))
    least = grouped.groupBy("root").agg(F.min("min_doc").alias("least"))
    of_class = grouped.join(least, "root").select(F.col("v").alias("_v"), "least")
    ids = reps.join(of_class, reps["cls"] == F.col("_v"), "left").select(F.col("cls").alias("_cls"), F.coalesce("least", "min_doc").alias("component_id"))
    out = sig.select("doc_id", "text_key", "n_shingles", "cls").join(ids, F.col("cls") == F.col("_cls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """One document of each component, with all its columns.

    Of rows that share a kept doc_id and their text, one stays.
    """
    verdict = near_duplicates(docs, width, percent)
    gone = stored(verdict.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")).distinct(), "near-gone")
    # only documents whose number may be among those that go are shuffled to find out
    numbers = F.broadcast(gone.select(number_of("_gone").alias("_number")).distinct())
    hit = number_of(docs["doc_id"]) == numbers["_number"]
    maybe = docs.join(numbers, hit, "left_semi")
    left = maybe.join(gone, maybe["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(maybe["text"]) == gone["_key"]), "left_anti")
    left = docs.join(numbers, hit, "left_anti").unionByName(left)
    repeated = verdict.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left
