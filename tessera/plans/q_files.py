"""Registered readers, writers and look-ups over data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import augment as A
from tessera.operators import embed as N
from tessera.operators import text as TX
from tessera.plans import fixtures as FX
from tessera.plans.q_boards import MAZE_SQL, MIN_RATING, SUDOKU_SQL
from tessera.plans.q_logic import _TEST_SQL, LOGIC_SQL, _test_categories
from tessera.plans.q_state import _EMB_SQL
from tessera.plans.registry import register
from tessera.sources import readers as S
from tessera.sources import sinks as K
from tessera.streaming.state import scratch_path


def _as_csv(df, path):
    # blanks at the ends are part of a board
    df.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@register("sudoku_csv", f"""WITH {SUDOKU_SQL}
SELECT source, rating, array_to_string(string_split(replace(q, '.', '0'), ''), ',') AS q, array_to_string(string_split(a, ''), ',') AS a
FROM sudoku WHERE rating >= {MIN_RATING}""")
def sudoku_csv(spark, sf_dir):
    """S3: boards written as CSV and read back with the rating filter."""
    path = scratch_path(spark, "sudoku")
    _as_csv(FX.sudoku_rows(spark, sf_dir), path)
    d = S.read_sudoku(spark, path, MIN_RATING)
    return d.select("source", "rating", F.array_join("q_cells", ",").alias("q"), F.array_join("a_cells", ",").alias("a"))


@register("maze_csv", f"""WITH {MAZE_SQL}
SELECT source, CAST(10 AS INTEGER) AS side, true AS shape_ok, q, a FROM maze""")
def maze_csv(spark, sf_dir):
    """Mazes written as CSV and read back with their side."""
    path = scratch_path(spark, "maze")
    _as_csv(FX.maze_rows(spark, sf_dir), path)
    return S.read_maze(spark, path).select("source", "side", "shape_ok", "q", "a")


@register("first_by_hash", "SELECT md5(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_by_hash(spark, sf_dir):
    """The first document of each text."""
    d = FX.table(spark, sf_dir, "documents").select(F.md5("text").alias("hash"), "doc_id")
    return A.dedup_by_hash(d, "hash", "doc_id").select("hash", "doc_id")


@register("embed_lookup", f"""WITH {_EMB_SQL}, n AS (SELECT count(*) AS n FROM embeddings)
SELECT e.event_id, t.id, round(list_sum(t.emb), 6) AS total FROM events e, n JOIN t ON t.id = e.user_id % n.n""")
def embed_lookup(spark, sf_dir):
    """The vector of every event's user."""
    table, _ = FX.embedding_deltas(spark, sf_dir)
    n = table.count() or 1
    ids = FX.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % n).alias("id"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return N.lookup(ids, table).select("event_id", "id", F.round(total, 6).alias("total"))


@register("vocab_reload", """
WITH c AS (SELECT tok AS token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lang, '\\w+|[^\\w\\s]+')) AS tok FROM documents) GROUP BY tok)
SELECT CAST(row_number() OVER (ORDER BY count DESC, token) AS INTEGER) AS id, token, count FROM c
UNION ALL SELECT 0, '[PAD]', NULL""")
def vocab_reload(spark, sf_dir):
    """X6 + X12: the vocabulary of all languages' names, saved and loaded."""
    path = scratch_path(spark, "vocab")
    TX.save_vocab(TX.build_vocab(FX.table(spark, sf_dir, "documents").select("lang"), ["[PAD]"], "lang"), path)
    return TX.load_vocab(spark, path)


@register("predictions_by_step", """
SELECT CAST(step AS INTEGER) AS step, event_type, count(*) AS n, sum(event_id + step) AS total FROM events, (VALUES (10), (20)) s(step) GROUP BY 1, 2""")
def predictions_by_step(spark, sf_dir):
    """K5: the wanted columns of two steps appended to one table, and read back by step."""
    path = scratch_path(spark, "steps")
    e = FX.table(spark, sf_dir, "events")
    for step in (10, 20):
        K.write_predictions(e.withColumn("key", F.col("event_id") + step), path, step, ["event_type", "key"])
    return spark.read.parquet(path).groupBy("step", "event_type").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


@register("predictions_replayed", """
SELECT CAST(step AS INTEGER) AS step, CAST(event_id % 2 AS INTEGER) AS batch_id, event_type, count(*) AS n, sum(event_id + step) AS total
FROM events, (VALUES (10), (20)) s(step) GROUP BY 1, 2, 3""")
def predictions_replayed(spark, sf_dir):
    """K5: two batches a step, the second written twice as a retried job does; each is there once."""
    path = scratch_path(spark, "replayed")
    e = FX.table(spark, sf_dir, "events")
    for step in (10, 20):
        for batch in (0, 1, 1):
            rows = e.filter(F.col("event_id") % 2 == batch).withColumn("key", F.col("event_id") + step)
            K.write_predictions(rows, path, step, ["event_type", "key"], batch)
    return spark.read.parquet(path).groupBy("step", "batch_id", "event_type").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


@register("category_files", f"""WITH {LOGIC_SQL}, {_TEST_SQL}
SELECT category, base_size, count(*) AS n, CAST(sum(seq_len) AS BIGINT) AS total_len FROM catd GROUP BY category, base_size""")
def category_files(spark, sf_dir):
    """K8: category subsets written by category, read back with their counts."""
    path = scratch_path(spark, "categories")
    K.write_categories(_test_categories(spark, sf_dir), path)
    rows = spark.read.parquet(f"{path}/rows").groupBy("category", "base_size").agg(F.sum("seq_len").cast("long").alias("total_len"))
    counts = spark.read.parquet(f"{path}/counts").withColumnRenamed("count", "n")
    return counts.join(rows, ["category", "base_size"]).select("category", "base_size", "n", "total_len")


@register("category_indices", f"""WITH {LOGIC_SQL}, {_TEST_SQL},
numbered AS (SELECT category, row_number() OVER (ORDER BY id) - 1 AS position, row_number() OVER (PARTITION BY category ORDER BY id) - 1 AS index FROM catd),
n AS (SELECT category, count(*) AS n FROM catd GROUP BY category),
o AS (SELECT category, CAST(coalesce(sum(n) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n FROM n)
SELECT category, index, position, start, start + n AS "end" FROM numbered JOIN o USING (category)
UNION ALL SELECT NULL, NULL, NULL, 0, count(*) FROM catd""")
def category_indices(spark, sf_dir):
    """K8 + D3: the index list of every category with its offsets, and the total."""
    path = scratch_path(spark, "category-indices")
    K.write_categories(_test_categories(spark, sf_dir), path, ["id"])
    offsets = spark.read.parquet(f"{path}/offsets")
    return offsets.join(spark.read.parquet(f"{path}/indices"), "category", "left").select("category", "index", "position", "start", "end")
