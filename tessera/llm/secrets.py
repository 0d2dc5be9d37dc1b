"""Secret scan: base patterns and sliding-window entropy of candidate strings.

Base patterns: assignments to a name like password or token, access keys, and
long hex strings. The method adds candidates: runs of key characters whose
most varied window of ``WINDOW`` characters has an entropy at or over the
limit of the candidate's character class. The window slides by one character;
what enters and what leaves change the sum of c * log2(c) by the difference at
their own counts, so no window is counted anew. Entropies are compared as whole
millionths of a bit. Candidates inside a base span are not reported twice, and
allow-listed forms (UUIDs, digits only, dotted or dashed numbers and dates) are
suppressed; base spans always stay.

Everything is one pass of DataFrame expressions, row by row: no shuffle, no
Python. Positions are code points, ends exclusive.

Defined cases: null and empty text have no spans; repeated rows are scanned
each; an empty table gives no rows. Other columns are neither read nor changed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
KINDS = ["assign", "access", "hex", "entropy"]
#: patterns; the group that has a least length; that length
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones can't be part of a longer match
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: class of a candidate, by the first pattern that fits, and its limit in millionths of a bit a character
CLASSES = {
    "digits": (r"^[0-9]+$", 9_000_000),
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3_000_000),
    "letters": (r"^[A-Za-z]+$", 4_150_000),
    "letters and digits": (r"^[A-Za-z0-9]+$", 3_700_000),
    "all": (r"^", 4_000_000),
}
ALLOWED = [r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^[0-9]+(?:[-_/=+][0-9]+)*$", r"^[=_/+-]+$"]
#: c * log2(c) in millionths, for c = 0 .. WINDOW
SUMS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for the value, worked out once (a lambda works out what it holds for every element)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def matches(pattern: str, least_group: int, least: int, kind: int) -> str:
    """SQL: spans (s, e, k, n, w) of the pattern in ``text``; one whose group is too short is passed over.

    Spans are folded in blocks of about the root of their number, then moved by
    the lengths of the blocks before: a fold copies what it has collected at every step.
    """
    p = literal(pattern)
    empty = "cast(array() as array<struct<s: int, e: int, k: int, n: int, w: string>>)"
    begin = "a.at + char_length(x['0'])"
    span = f"named_struct('s', {begin}, 'e', {begin} + char_length(x['1']), 'k', {kind}, 'n', x['2'], 'w', x['1'])"
    # text between matches, matches, and the lengths of their groups, one after the other
    parts = (f"arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), "
             f"transform(regexp_extract_all(text, {p}, {least_group}), g -> char_length(g)))")
    width = "cast(ceil(sqrt(size(ps))) as int)"
    block = (f"aggregate(slice(ps, i * {width} + 1, {width}), named_struct('at', 0, 'out', {empty}), "
             f"(a, x) -> named_struct('at', {begin} + coalesce(char_length(x['1']), 0), 'out', if(x['1'] is null, a.out, concat(a.out, array({span})))))")
    blocks = f"transform(sequence(0, cast((size(ps) - 1) div {width} as int)), i -> {block})"
    starts = "aggregate(bs, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x.at)))"
    moved = (f"flatten(zip_with(bs, slice({starts}, 1, size(bs)), (x, at) -> transform(x.out, "
             "m -> named_struct('s', m.s + at, 'e', m.e + at, 'k', m.k, 'n', m.n, 'w', m.w))))")
    walk = bound(parts, "ps", bound(blocks, "bs", moved))
    return f"if(rlike(text, {p}), filter({walk}, m -> m.n >= {least}), {empty})"


def base_spans() -> str:
    parts = [matches(p, g, n, KINDS.index(k)) for k, (p, g, n) in BASE.items()]
    return "concat(" + ", ".join(f"transform({x}, m -> named_struct('s', m.s, 'e', m.e, 'k', m.k))" for x in parts) + ")"


def least_sum(chars: Column) -> Column:
    """Least sum of c * log2(c), in millionths, over the windows of an array of characters."""
    table = F.array(*[F.lit(x) for x in SUMS])
    n = F.size(chars)

    def equal(x: Column, first: Column, length: Column) -> Column:
        return F.size(F.filter(F.slice(chars, first, length), lambda c: c == x))

    def step(a: Column, i: Column) -> Column:  # i from 1
        full = i > WINDOW
        out = F.element_at(chars, F.greatest(i - WINDOW, F.lit(1)))
        gone = F.when(full, equal(out, F.greatest(i - WINDOW, F.lit(1)), F.lit(WINDOW))).otherwise(F.lit(1))
        come = equal(F.element_at(chars, i), F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i - 1, F.lit(WINDOW - 1)))
        now = a["sum"] + table[gone - 1] - table[gone] + table[come + 1] - table[come]
        least = F.when(i >= WINDOW, F.least(a["least"], now)).otherwise(a["least"])
        return F.struct(now.alias("sum"), least.alias("least"))

    zero = F.struct(F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("least"))
    return F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda a: a["least"])


def limit(word: Column) -> Column:
    out = F.lit(None).cast("int")
    for p, bits in reversed(CLASSES.values()):
        out = F.when(word.rlike(p), F.lit(bits)).otherwise(out)
    return out


def spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``base`` and ``found``: spans (s, e, k) of base patterns and of the entropy method."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], text)
    rows = rows.withColumn("base", F.expr(base_spans())).withColumn(
        "near", F.expr(f"transform({matches(CANDIDATE, 0, WINDOW, 3)}, m -> named_struct('s', m.s, 'e', m.e, 'k', m.k, 'word', m.w))"))
    allowed = " or ".join(f"rlike(c.word, {literal(p)})" for p in ALLOWED)
    rows = rows.withColumn("near", F.expr(f"filter(near, c -> not ({allowed}) and not exists(base, b -> b.s <= c.s and b.e >= c.e))"))
    most = math.log2(WINDOW)

    def varied(c: Column) -> Column:
        # entropy = log2(window) - sum / window
        # the characters are bound first: a lambda works out what it holds for every element
        least = F.element_at(F.transform(F.array(F.split(c["word"], "")), least_sum), 1)
        return F.round(F.lit(most * 1e6 * WINDOW)).cast("long") - least >= limit(c["word"]).cast("long") * WINDOW

    found = F.transform(F.filter("near", varied), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k")))
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "base", found.alias("found"))


def listed(column: str) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = "array(" + ", ".join(literal(k) for k in KINDS) + ")"
    order = f"array_sort(transform({column}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))"
    return F.expr(f"array_join(transform({order}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def secret_digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    rows = spans(docs, keep).withColumn("all", F.concat("base", "found"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {KINDS.index(k)})) as bigint)").alias(f"n_{k}") for k in BASE]
    return rows.select(*keep, *counts, F.size("found").cast("long").alias("n_entropy"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))
