"""Q1-Q7: size parsing, per-size maxima, category lookup, rollup counts, subset selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ids import build_metadata

# Size classes of logic grids (houses*attributes).
CATEGORIES = {
    "Small": ["2*2", "2*3", "2*4", "2*5", "2*6", "3*2", "3*3", "4*2"],
    "Medium": ["3*4", "3*5", "3*6", "4*3", "4*4", "5*2", "6*2"],
    "Large": ["4*5", "5*3", "4*6", "5*4", "6*3"],
    "X-Large": ["5*5", "6*4", "5*6", "6*5", "6*6"],
}


def parse_size(df: DataFrame, size_col: str = "size") -> DataFrame:
    """Q1: 'X*Y*Z' -> base 'X*Y', length Z; rows with fewer than 3 parts are dropped."""
    parts = F.split(F.col(size_col), r"\*")
    return df.filter(F.size(parts) >= 3).withColumn(
        "base_size", F.concat_ws("*", F.element_at(parts, 1), F.element_at(parts, 2))) \
        .withColumn("seq_len", F.element_at(parts, 3).cast("int"))


def keep_max_length(df: DataFrame) -> DataFrame:
    """Q4: rows whose length is the maximum of their base size (aggregate + join)."""
    mx = df.groupBy("base_size").agg(F.max("seq_len").alias("_mx"))
    return df.join(mx, "base_size").filter(F.col("seq_len") == F.col("_mx")).drop("_mx")


def category_table(spark) -> DataFrame:
    rows = [(size, cat) for cat, sizes in CATEGORIES.items() for size in sizes]
    return spark.createDataFrame(rows, "base_size string, category string")


def attach_category(df: DataFrame) -> DataFrame:
    """Q5: broadcast lookup (the table has 25 rows), 'Unknown' otherwise."""
    cats = category_table(df.sparkSession)
    return df.join(F.broadcast(cats), "base_size", "left").withColumn(
        "category", F.coalesce(F.col("category"), F.lit("Unknown")))


def category_counts(df: DataFrame) -> DataFrame:
    """Q6: count per category, per (category, size), and the total, in one rollup pass."""
    return df.rollup("category", "base_size").agg(F.count("*").alias("n"))


def select_subset(dataset: DataFrame, selected: DataFrame, key: str, spec: dict) -> tuple[DataFrame, DataFrame]:
    """Q7: semi-join a built dataset by selected keys and recompute its metadata."""
    sub = dataset.join(selected.select(key).distinct(), key, "left_semi")
    return sub, build_metadata(sub, spec)
