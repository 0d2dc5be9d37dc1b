"""Alignment of two tokenizers' ids over a corpus, by inverted pair bitmaps.

1. Both tokenizers encode every text. Byte offsets where a token of each ends
   cut the two sequences into groups; the tokens of a group are linked, each of
   one side with each of the other.
2. Documents are numbered by container (runs of up to 4,096 documents of one
   task). For each linked pair of ids a container keeps a compressed bitmap of
   the documents that hold it (a list of positions while they are few, bits when they are
   many), chunk by chunk OR-ed together, and multiplicity planes: bitmaps for
   the binary digits of how often beyond once a document holds it. Population
   counts of the bitmaps, added over containers, give a pair's count of
   documents; those of the planes, weighed by their digit, its links.
3. The postings (pair, container, bitmap, planes) meet their pair's count and
   go back to their containers, where each bitmap and plane adds the count to
   the documents it names.

A frequent pair has one posting a container, so no row and no group grows with
the corpus; a join on a pair that a third of all documents hold is split by
AQE, and sums are added up before they are shuffled. A container closes early
when its postings are many, so that a task that scores one holds a bounded
table. Groups with many tokens on both sides are linked by distinct ids and
their numbers, so a long stretch without a common end makes no list of all its
links.

Defined cases: a null or empty text, and one whose tokens on either side don't
spell a space and the text, has no tokens: counts are 0 and the digest is ''.
Repeated rows and ids are documents of their own; an empty table gives no rows.
Other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.cut_encoder import ByteLevelEncoder, CutEncoder, PieceEncoder, encoder
from tessera.llm.tables import scratch, stored
from tessera.llm.words import CHUNK_BYTES, chunks, ranges, row_sums, utf8

#: documents a container, and links (distinct in their document) after which it closes
DOCS, LINKS = 1 << 12, 1 << 21
#: a posting with fewer documents lists them in two bytes each; the bitmap takes DOCS / 8 bytes
SPARSE = DOCS // 16
#: links of a group that are listed one by one
LISTED = 256
KEPT_CUTS = 1 << 20

_DIGITS = 10 ** np.arange(6, -1, -1, dtype=np.int64)


@dataclass
class Aligned:
    """Tokens of the documents of a chunk, and the groups they fall into.

    ids: of each side; group: of each token; rows: of each side, token offsets
    of the documents; groups: group offsets of the documents.
    """

    ids: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    rows: tuple[np.ndarray, np.ndarray]
    groups: np.ndarray

    @property
    def n(self) -> int:
        return len(self.groups) - 1

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each side in each group."""
        n = int(self.groups[-1])
        return np.bincount(self.group[0], minlength=n), np.bincount(self.group[1], minlength=n)

    def strings(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        size = self.sizes()
        before = [np.concatenate([[0], np.cumsum(s)]) for s in size]
        a, b = self.ids
        # the place of each token when the sides of a group stand one after the other
        at_a = np.arange(len(a)) + before[1][self.group[0]]
        at_b = np.arange(len(b)) + before[0][self.group[1] + 1]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[before[0][1:] - 1]] = ord("|")
        mark[at_b[before[1][1:] - 1]] = ord(";")
        digits = np.searchsorted(_DIGITS[::-1], ids, side="right").clip(1)
        end = np.cumsum(digits + 1)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        for k in range(int(digits.max(initial=0))):  # k-th digit from the last
            has = digits > k
            out[end[has] - 2 - k] = 48 + ids[has] // 10 ** k % 10
        out[end - 1] = mark
        offs = np.concatenate([[0], end])[self.rows[0] + self.rows[1]]
        raw = out.tobytes()
        return [raw[i:max(i, j - 1)] for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, a, b, number) of links, some named more than once."""
        size_a, size_b = self.sizes()
        a, b = self.ids
        many = size_a * size_b > LISTED
        begin_b = np.cumsum(size_b) - size_b
        group = self.group[0]
        count = np.where(many, 0, size_b)[group]
        left = np.repeat(np.arange(len(a)), count)
        right = ranges(begin_b[group], count)
        parts = [(group[left], a[left], b[right], np.ones(len(left), np.int64))]
        begin_a = np.cumsum(size_a) - size_a
        for g in np.flatnonzero(many).tolist():
            ids_a, n_a = np.unique(a[begin_a[g]:begin_a[g] + size_a[g]], return_counts=True)
            ids_b, n_b = np.unique(b[begin_b[g]:begin_b[g] + size_b[g]], return_counts=True)
            parts.append((np.full(len(ids_a) * len(ids_b), g), np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a)), np.outer(n_a, n_b).reshape(-1)))
        group, ids_a, ids_b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return np.searchsorted(self.groups, group, side="right") - 1, ids_a.astype(np.int64), ids_b.astype(np.int64), n


def aligned(data: np.ndarray, text: np.ndarray, encoders: tuple[CutEncoder, CutEncoder], lengths: tuple[np.ndarray, np.ndarray]) -> Aligned:
    """Groups of the rows of a chunk; ``lengths`` are the bytes of each id. Rows without tokens are empty documents."""
    size = np.diff(text)
    # a space before each row that has a text
    full = size > 0
    spaced = np.insert(data, text[:-1][full], 32)
    text = np.concatenate([[0], np.cumsum(size + full)])
    found = [e.encode_checked(spaced, text) for e in encoders]
    spelt = found[0][2] & found[1][2] & full
    sides = []
    for (ids, rows, _), length in zip(found, lengths, strict=True):
        n = np.where(spelt, np.diff(rows), 0)
        ids = ids[ranges(rows[:-1], n)]
        sides.append((ids, np.concatenate([[0], np.cumsum(n)]), np.cumsum(length[ids])))
    mark = np.zeros(int(text[-1]) + 1, bool)
    mark[sides[0][2]] = True
    ends = sides[1][2][mark[sides[1][2]]]
    groups = np.searchsorted(ends, np.cumsum(np.where(spelt, size + 1, 0)), side="right")
    return Aligned((sides[0][0], sides[1][0]), (np.searchsorted(ends, sides[0][2]), np.searchsorted(ends, sides[1][2])),
                   (sides[0][1], sides[1][1]), np.concatenate([[0], groups]))


def sets(key: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bitmaps of sorted (key, position): first element of each key's run, its cardinality, and the compressed bitmaps."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    bits = n >= SPARSE
    length = np.where(bits, DOCS // 8, 2 * n)
    offs = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(int(offs[-1]), np.uint8)
    few = np.repeat(~bits, n)
    out[ranges(offs[:-1][~bits], length[~bits])] = position[few].astype("<u2").view(np.uint8)
    row = np.repeat(np.cumsum(bits) - 1, n)[~few]
    dense = np.zeros((int(bits.sum()), DOCS), np.uint8)
    dense[row, position[~few]] = 1
    out[ranges(offs[:-1][bits], length[bits])] = np.packbits(dense, axis=1, bitorder="little").reshape(-1)
    return first, n, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def positions(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, position) of all elements of compressed bitmaps."""
    data, offs = utf8(bitmaps)
    length = np.diff(offs)
    bits = length == DOCS // 8
    few = np.flatnonzero(~bits)
    sparse = np.ascontiguousarray(data[ranges(offs[few], length[few])]).view("<u2").astype(np.int64)
    dense = np.flatnonzero(bits)
    row, position = np.nonzero(np.unpackbits(data[ranges(offs[dense], length[dense])].reshape(-1, DOCS // 8), axis=1, bitorder="little"))
    return np.concatenate([np.repeat(few, length[few] // 2), dense[row]]), np.concatenate([sparse, position])


POSTING = "container bigint, a int, b int, n_docs int, n_links bigint, docs binary, planes array<binary>"
DOCUMENT = "container bigint, position int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


@dataclass
class Container:
    """Links of the documents of a container: sorted keys of (a, b, position) and numbers."""

    n: int = 0
    key: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    number: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def add(self, a: np.ndarray, b: np.ndarray, position: np.ndarray, number: np.ndarray) -> None:
        """OR-s documents into the sets of their pairs and adds up numbers."""
        key = np.concatenate([self.key, (a << 37) | (b << 12) | position])
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.key, self.number = key[first], np.add.reduceat(np.concatenate([self.number, number])[order], first)

    def postings(self, container: int) -> tuple[list[pa.Array], int]:
        """Columns of POSTING, and the number of rows."""
        pair, position = self.key >> 12, self.key & (DOCS - 1)
        first, n, docs = sets(pair, position)
        number = self.number - 1
        top = int(number.max(initial=0)).bit_length()
        digit, element = np.nonzero((number >> np.arange(top)[:, None]) & 1)
        row = np.searchsorted(first, element, side="right") - 1
        order = np.lexsort((element, digit, row))
        row, digit, element = row[order], digit[order], element[order]
        in_plane, _, planes = sets(row * (top + 1) + digit, position[element])
        # every plane up to a pair's highest digit, empty ones included, so that a plane's place is its digit
        height = np.zeros(len(first), np.int64)
        np.maximum.at(height, row, digit + 1)
        base = np.concatenate([[0], np.cumsum(height)])
        slot = np.full(int(base[-1]), -1, np.int64)
        slot[base[row[in_plane]] + digit[in_plane]] = np.arange(len(in_plane))
        filled = planes.take(pa.array(slot, mask=slot < 0)).fill_null(b"")
        links = np.add.reduceat(self.number, first) if len(first) else np.empty(0, np.int64)
        return [pa.array(np.full(len(first), container)), pa.array((pair[first] >> 25).astype(np.int32)), pa.array((pair[first] & ((1 << 25) - 1)).astype(np.int32)),
                pa.array(n.astype(np.int32)), pa.array(links), docs, pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), filled)], len(first)


def _rows(schema: T.StructType, columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    own = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in own], schema=own)


def postings(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(POSTING rows, DOCUMENT rows): one pass over the texts, written once as two kinds of rows."""
    document, posting = T._parse_datatype_string(DOCUMENT), T._parse_datatype_string(POSTING)
    both = T.StructType([T.StructField("kind", T.StringType()), *document.fields, *(f for f in posting.fields if f.name not in document.names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        own = (encoder(ByteLevelEncoder, a_path, specials=False, kept=KEPT_CUTS, slots=2 * KEPT_CUTS), encoder(PieceEncoder, b_path, kept=KEPT_CUTS, slots=2 * KEPT_CUTS))
        lengths = tuple(np.array([len(t) for t in e.token_bytes()], np.int64) for e in own)
        held = Container()

        def closed() -> pa.RecordBatch:
            columns, n = held.postings(number)
            return _rows(both, dict(zip(posting.names, columns, strict=True)) | {"kind": pa.array(["posting"] * n)}, n)

        for batch in batches:
            for first, data, text in chunks(*utf8(batch.column(1)), CHUNK_BYTES):
                found = aligned(data, text, own, lengths)
                size_a, size_b = found.sizes()
                n_links = row_sums(size_a * size_b, found.groups)
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in found.strings()]
                doc, a, b, times = found.links()
                begin = 0
                while begin < found.n:  # documents of the chunk that go to one container
                    n = min(found.n - begin, DOCS - held.n)
                    part = (doc >= begin) & (doc < begin + n)
                    held.add(a[part], b[part], doc[part] - begin + held.n, times[part])
                    own_rows = slice(begin, begin + n)
                    yield _rows(both, {
                        "kind": pa.array(["document"] * n), "container": pa.array(np.full(n, number)), "position": pa.array(np.arange(held.n, held.n + n)),
                        "doc_id": batch.column(0).slice(first + begin, n), "n_a": pa.array(np.diff(found.rows[0])[own_rows]),
                        "n_b": pa.array(np.diff(found.rows[1])[own_rows]), "n_groups": pa.array(np.diff(found.groups)[own_rows]),
                        "n_links": pa.array(n_links[own_rows]), "groups_sha256": pa.array(sha[own_rows])}, n)
                    held.n += n
                    begin += n
                    if held.n == DOCS or len(held.key) > LINKS:
                        yield closed()
                        held, number = Container(), number + 1
        if held.n:
            yield closed()

    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, both), "postings", by="kind")
    return rows.where("kind = 'posting'").select(*posting.names), rows.where("kind = 'document'").select(*document.names)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best): documents that hold each pair and links there; best: no pair of that a is in more documents."""
    pairs = stored(postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")), "pairs")
    top = pairs.groupBy(F.col("a").alias("_a")).agg(F.max("n_docs").alias("_top"))
    return pairs.join(top, F.col("a") == F.col("_a")).select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("_top")).alias("best"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(container, position, n_best, count_sum) of documents with links: what the postings of each container return."""
    pairs = counts.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n_docs").alias("n"), "best")
    met = postings.select("container", "a", "b", "docs", "planes").join(pairs.hint("merge"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    home = met.select("container", "docs", "planes", "n", "best").repartition("container").sortWithinPartitions("container")
    schema = T._parse_datatype_string("container bigint, position int, n_best bigint, count_sum bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros((2, DOCS), np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(DOCS, now)), pa.array(np.arange(DOCS, dtype=np.int32)), *map(pa.array, total)], names=schema.names).filter(
                pa.array(total[1] > 0))

        for batch in batches:
            container = batch.column(0).to_numpy()
            value = np.stack([batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(3).to_numpy()])
            edge = np.flatnonzero(np.concatenate([[True], container[1:] != container[:-1], [True]])) if len(container) else np.zeros(1, np.int64)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if now is not None and container[i] != now:
                    yield done()
                    total[:] = 0
                now = int(container[i])
                planes = batch.column(2).slice(i, j - i)
                height = planes.value_lengths().to_numpy()
                owner = np.repeat(np.arange(i, j), height)
                digit = np.arange(len(owner)) - np.repeat(np.cumsum(height) - height, height)
                for bitmaps, row, weight in ((batch.column(1).slice(i, j - i), np.arange(i, j), None), (planes.flatten(), owner, digit)):
                    which, position = positions(bitmaps)
                    for k in (0, 1):
                        own = value[k, row[which]]
                        np.add.at(total[k], position, own if weight is None else own << weight[which])
        if now is not None:
            yield done()

    return home.mapInArrow(run, schema)


def alignment(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): what each document holds and what its links score, and the counts of each pair of ids."""
    with scratch(docs.sparkSession, "alignment"):
        held, rows = postings(docs, a_path, b_path)
        counts = stored(pair_counts(held), "pair-counts", keep=True)
        back = scores(held, counts).select(F.col("container").alias("_container"), F.col("position").alias("_position"), "n_best", "count_sum")
        met = rows.join(back, (F.col("container") == F.col("_container")) & (F.col("position") == F.col("_position")), "left")
        out = met.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
        return stored(out, "alignment", keep=True), counts
