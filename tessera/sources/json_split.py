"""One large JSON object or array, read by many tasks.

The file is read as text that ends lines at a character that can close an
entry, so Spark splits it by byte ranges as it does any text file. Whether a
piece begins inside a string, and how deep, follows from all pieces before it:
each split adds up its own quotes and brackets, for both answers to "does it
begin inside a string", and one row a split then tells every piece where it
stands. Pieces up to the one that ends on the top level make an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialise


def _depth_change(outside: Column) -> Column:
    return F.length(F.translate(outside, "]}", "")) - F.length(F.translate(outside, "[{", ""))


def _pieces(spark: SparkSession, path, sep: str) -> DataFrame:
    """Every piece with its quotes, its change of depth and where that leads inside its split, for both
    answers (0: the split begins outside a string, 1: inside)."""
    t = spark.read.option("lineSep", sep).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # a separator can't be escaped, so no piece begins in an escape
    quotes = F.length(bare) - F.length(F.translate(bare, '"', ""))
    closes = 0 if sep == "," else 1

    def change(inside: int) -> Column:
        text = F.concat(F.lit('"'), bare) if inside else bare
        at_end = (quotes + inside) % 2
        return _depth_change(F.regexp_replace(text, '"[^"]*("|$)', "")) - F.when(at_end == 0, closes).otherwise(0)

    t = t.withColumns({"quotes": quotes, "from_out": change(0), "from_in": change(1)})
    w = Window.partitionBy("file", "block").orderBy("pos")
    before = F.coalesce(F.sum("quotes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    t = t.withColumn("before", before)
    for answer in (0, 1):
        t = t.withColumn(f"d{answer}", F.when(F.col("before") == answer, F.col("from_out")).otherwise(F.col("from_in")))
        t = t.withColumn(f"depth{answer}", F.sum(f"d{answer}").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.drop("from_out", "from_in")


def _numbered(spark: SparkSession, path, sep: str) -> DataFrame:
    """Pieces (file, block, pos, value) with ``entry``: the ends of top-level entries before them in the file."""
    t = materialise(_pieces(spark, path, sep))  # positions must stay as they were counted
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = t.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(in_file), F.lit(0)) % 2)
    splits = splits.withColumn("base", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))).over(in_file), F.lit(0)))
    here = F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    outside = (F.col("inside") + F.col("before") + F.col("quotes")) % 2 == 0
    # one row a split
    t = t.join(F.broadcast(splits.select("file", "block", "inside", "base")), ["file", "block"])
    t = t.select("file", "block", "pos", "value", F.when(outside & (F.col("base") + here == 1), 1).otherwise(0).alias("end"))
    ends = t.groupBy("file", "block").agg(F.sum("end").alias("ends"))
    ends = ends.select("file", "block", F.coalesce(F.sum("ends").over(in_file), F.lit(0)).alias("first"))
    w = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("entry", F.coalesce(F.sum("end").over(w), F.lit(0)))
    return t.join(F.broadcast(ends), ["file", "block"]).withColumn("entry", F.col("entry") + F.col("first")).drop("first", "end")


def _joined(spark: SparkSession, path, sep: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("block", "pos", "value")))
    return _numbered(spark, path, sep).groupBy("file", "entry").agg(F.array_join(F.transform(parts, lambda p: p["value"]), sep).alias("text"))


def object_entries(spark: SparkSession, path, close: str = "}") -> DataFrame:
    """(value): a JSON object {key: entry} for each top-level entry of the objects in ``path``.

    ``close`` is the character that ends an entry: '}' where entries are
    objects, ']' where they are arrays. A file may hold one object or several
    after each other; an empty object or file gives no rows.
    """
    text = F.regexp_replace(F.concat("text", F.lit(close)), r"^[\s,{}\[\]]+", "")
    return _joined(spark, path, close).select(text.alias("text")).filter(F.col("text").startswith('"')) \
        .select(F.concat(F.lit("{"), "text", F.lit("}")).alias("value"))


def array_elements(spark: SparkSession, path) -> DataFrame:
    """(pos, value): the strings of the JSON array in each file of ``path``, with their positions."""
    text = F.regexp_replace("text", r"^\s*\[\s*|\s*\]\s*$", "")
    return _joined(spark, path, ",").select("entry", text.alias("text")).filter(F.trim("text") != "") \
        .select(F.col("entry").cast("int").alias("pos"), F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")[0].alias("value"))
