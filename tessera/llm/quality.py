"""Quality rules with thresholds that adapt to each language and source.

A first pass measures every document. A quantile sketch of four ratios (counts
of logarithmic bins, which add up: tasks count their own documents and the sums
are merged after the shuffle, so a source that holds a third of all rows is
sketched by many tasks) gives the quartiles of each (language, source) to within
``ACCURACY`` of their value, and the same ones whatever the order or the layout
of the rows; a document fails where a ratio lies beyond its group's
fence, Q3 + reach * max(Q3 - Q1, least spread). The thresholds are a table of
one row a group, joined to the documents in the second pass.

Ratios: symbols per character of words, repeated lines per line, words in
repeated windows per word (all fenced above), and characters per word (fenced
on both sides). The least spread keeps a group whose documents are all alike
from failing the first that differs a little.

Base rules: fewer than 50 words, or more than half of them in repeated windows.

Defined cases: null text has no words and fails the base; a null language or
source is a group of its own; a group of one document has no spread and fails
none by threshold; repeated rows and ids are judged row by row; an empty table
gives no rows. Other columns are neither read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import map_texts, stored
from tessera.llm.words import SPACED, Words, mix, row_sums, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REACH = 6.0
#: ratio -> least spread
SPREAD = {"symbol_ratio": 0.01, "dup_line_ratio": 0.06, "repeat_ratio": 0.04, "word_length": 0.5}

#: relative error of a quantile
ACCURACY = 0.0005
#: bin of the ratio 0
NOTHING = -(2**31)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(chunk: Words, width: int) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in that row."""
    h, rows = chunk.hash, chunk.rows
    n = len(h)
    count = np.diff(rows)
    out = np.zeros(chunk.n, np.int64)
    if n < width + 1:
        return out
    window = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        window = mix(window ^ h[k:n - width + 1 + k], k + 2)
    for d in np.flatnonzero(count > width).tolist():
        a, b = rows[d], rows[d + 1]
        own = window[a:b - width + 1]
        order = np.argsort(own)
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(b - a, bool)
            for k in range(width):
                covered[k:k + len(own)] |= twice
            out[d] = covered.sum()
    return out


def line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0b\x0c\x0d")]
    return len(lines), len(lines) - len(set(lines))


def measure(text: pa.Array, width: int = 3) -> list[pa.Array]:
    """The columns COUNTS of a batch of texts."""
    parts: list[list[np.ndarray]] = []
    for chunk in words(text, SPACED):
        data = chunk.data
        point = (data & 0xC0) != 0x80
        lines = [line_counts(data[a:b].tobytes().decode("utf-8", "surrogatepass")) for a, b in zip(chunk.text[:-1].tolist(), chunk.text[1:].tolist(), strict=True)]
        n_lines, n_dup = np.array(lines, np.int64).reshape(-1, 2).T
        parts.append([np.diff(chunk.rows), row_sums(point & (SPACED[data] != 0), chunk.text), row_sums(_SYMBOL[data], chunk.text), n_lines, n_dup, repeated_words(chunk, width)])
    return [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64), pa.int64()) for i in range(len(COUNTS))]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A struct ``row`` of the columns ``keep``, lang, source, and a struct ``found`` of COUNTS, one row per row."""
    found = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    source = docs.select(F.struct(*keep).alias("row"), "lang", "source", "text")
    schema = T.StructType([*source.schema.fields[:3], T.StructField("found", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.StructArray.from_arrays(measure(batch.column(3)), names=COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), got], names=schema.names)

    return map_texts(source, run, schema)


def ratios() -> dict[str, Column]:
    c = {k: F.col(f"found.{k}").cast("double") for k in COUNTS}
    return {"symbol_ratio": c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1.0)), "dup_line_ratio": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
            "repeat_ratio": c["n_repeat_words"] / F.greatest(c["n_words"], F.lit(1.0)), "word_length": c["word_chars"] / F.greatest(c["n_words"], F.lit(1.0))}


def base_failed() -> Column:
    return (F.col("found.n_words") < MIN_WORDS) | (100 * F.col("found.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("found.n_words"))


def sketched(passed: DataFrame) -> DataFrame:
    """(lang, source, ratio, bin, n) of rows (lang, source, ratios): the mergeable sketch, whose bins are powers of
    (1 + ACCURACY) / (1 - ACCURACY)."""
    step = math.log((1 + ACCURACY) / (1 - ACCURACY))
    each = passed.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), F.col(k).alias("x")) for k in SPREAD])).alias("r"))
    place = F.when(F.col("r.x") > 0, F.ceil(F.log("r.x") / step)).otherwise(NOTHING).cast("int")
    return each.groupBy("lang", "source", F.col("r.ratio").alias("ratio"), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, at: list[float]) -> DataFrame:
    """(lang, source, ratio, q0, q1, ...): the middle of the bin that holds the row of rank floor(q * (rows - 1))."""
    group = Window.partitionBy("lang", "source", "ratio")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = sketch.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    step = math.log((1 + ACCURACY) / (1 - ACCURACY))
    middle = F.when(F.col("bin") == NOTHING, 0.0).otherwise(F.exp(F.col("bin") * step) * (1 - ACCURACY))
    return placed.groupBy("lang", "source", "ratio").agg(*[
        F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q), middle)).alias(f"q{i}") for i, q in enumerate(at)])


def thresholds(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """(lang, source, low and high of each ratio) from the documents that pass the base."""
    passed = measured(docs, ["lang"]).where(~base_failed()).select("lang", "source", *[v.alias(k) for k, v in ratios().items()])
    found = quantiles(sketched(passed), [0.25, 0.75])
    least = F.create_map(*[F.lit(x) for pair in SPREAD.items() for x in pair])[F.col("ratio")]
    spread = F.greatest(F.col("q1") - F.col("q0"), least) * reach
    found = found.withColumns({"low": F.col("q0") - spread, "high": F.col("q1") + spread})
    sides = [F.max(F.when(F.col("ratio") == k, F.col(side))).alias(f"{side}_{k}") for k in SPREAD for side in ("low", "high")]
    return found.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*sides)


def judged(docs: DataFrame, keep: list[str], reach: float = REACH) -> DataFrame:
    """Structs ``row`` (the columns ``keep``), ``found`` (COUNTS), and ``verdict`` (base_failed, passed)."""
    limits = stored(thresholds(docs, reach), "quality-thresholds")
    both = measured(docs, keep).join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for k, v in ratios().items():
        inside = inside & F.coalesce(v <= F.col(f"high_{k}"), F.lit(True))
    inside = inside & F.coalesce(ratios()["word_length"] >= F.col("low_word_length"), F.lit(True))
    return both.select("row", "found", F.struct(base_failed().alias("base_failed"), (~base_failed() & inside).alias("passed")).alias("verdict"))


def quality_filtered(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judged(docs, docs.columns, reach).where("verdict.passed").select("row.*")
