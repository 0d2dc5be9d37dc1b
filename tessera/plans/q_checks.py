"""Registered expectation and prediction-surface queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.operators import expect as V
from tessera.operators import extend as U
from tessera.operators import votes as VT
from tessera.plans import fixtures as FX
from tessera.plans.q_boards import MAZE_SQL, SUDOKU_SQL
from tessera.plans.registry import register
from tessera.plans.sqlfixtures import GRIDS
from tessera.streaming.state import scratch_path


@register("expectations", f"""WITH {GRIDS.strip().rstrip(',')},
{SUDOKU_SQL.strip()}, {MAZE_SQL.strip()}
SELECT 'V1_grid' AS rule, CAST(count(*) FILTER (WHERE NOT (len(grid) BETWEEN 1 AND 30 AND len(grid[1]) BETWEEN 1 AND 30
       AND list_bool_and(list_transform(grid, lambda r: len(r) = len(grid[1]) AND list_bool_and(list_transform(r, lambda x: x BETWEEN 0 AND 9))))))
       AS BIGINT) AS violations FROM grids
UNION ALL SELECT 'V2_sudoku', CAST(count(*) FILTER (WHERE NOT (length(q) = 81 AND regexp_full_match(q, '[0-9.]{{81}}')
       AND length(a) = 81 AND regexp_full_match(a, '[0-9.]{{81}}'))) AS BIGINT) FROM sudoku
UNION ALL SELECT 'V3_maze', CAST(count(*) FILTER (WHERE NOT (regexp_full_match(q, '[# SGo]*') AND regexp_full_match(a, '[# SGo]*'))) AS BIGINT) FROM maze
UNION ALL SELECT 'V3_documents_ascii', CAST(count(*) FILTER (WHERE NOT regexp_full_match(text, '[ -~\\n]*')) AS BIGINT) FROM documents""")
def expectations(spark, sf_dir):
    """V1-V3 over the grid, sudoku and maze fixtures, plus a charset rule that documents break."""
    _, s1 = V.expect(FX.embedding_grids(spark, sf_dir), {"V1_grid": G.is_valid_grid(F.col("grid"))})
    sud = FX.sudoku_rows(spark, sf_dir)
    _, s2 = V.expect(sud, {"V2_sudoku": V.sudoku_strings_ok(F.col("q")) & V.sudoku_strings_ok(F.col("a"))})
    mz = FX.maze_rows(spark, sf_dir)
    _, s3 = V.expect(mz, {"V3_maze": V.within_charset(F.col("q"), FX.MAZE_CHARSET) & V.within_charset(F.col("a"), FX.MAZE_CHARSET)})
    docs = FX.table(spark, sf_dir, "documents")
    _, s4 = V.expect(docs, {"V3_documents_ascii": F.col("text").rlike(r"^[ -~\n]*$")})
    return s1.unionByName(s2).unionByName(s3).unionByName(s4)


@register("vocab_missing_ids", """
WITH c AS (SELECT tok AS token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''),
           '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]+')) AS tok FROM documents) GROUP BY tok HAVING count(*) >= 2)
SELECT count(*) AS n_entries, CAST(0 AS BIGINT) AS n_missing FROM c WHERE token NOT IN ('[PAD]', '[UNK]', '[BOP]', '[EOP]')""")
def vocab_missing_ids(spark, sf_dir):
    """V4 on the X6 vocabulary: ids are compact 0..n-1 (entries counted without specials)."""
    from tessera.operators.text import build_vocab
    from tessera.functions.text import LOGIC_SPECIALS
    vocab = build_vocab(FX.table(spark, sf_dir, "documents").select("text"), LOGIC_SPECIALS, min_freq=2)
    miss = V.missing_ids(vocab).agg(F.count("*").alias("n_missing"))
    n = vocab.filter(F.col("count").isNotNull()).agg(F.count("*").alias("n_entries"))
    return n.crossJoin(miss)


@register("predict_dummy")
def predict_dummy(spark, sf_dir):
    """The shipped copy-input model run per Arrow batch on the F2 prediction inputs,
    then decoded and voted like any model output (E1-E5)."""
    preds, identifiers, _ = FX.grid_predictions(spark, sf_dir)
    out = U.predict(preds.select("puzzle_identifier", "inputs"), U.copy_input_model,
                    "puzzle_identifier int, inputs array<int>, preds array<int>, q_halt_logits double")
    return VT.vote_table(VT.decode_predictions(out, identifiers, with_grid=False), with_grid=False)


_RULES_SQL = {"ascii": "regexp_full_match(text, '[ -~\\n]*')", "english": "lang = 'en'", "over_200": "length(text) > 200"}


@register("checked_write", "WITH r AS (SELECT " + ", ".join(f"coalesce({c}, false) AS {n}" for n, c in _RULES_SQL.items()) + """ FROM documents)
""" + "\nUNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT {n}) AS violations FROM r" for n in _RULES_SQL) + """
UNION ALL SELECT 'rows written', count(*) FILTER (WHERE ascii AND english AND over_200) FROM r""")
def checked_write(spark, sf_dir):
    """V1-V7 in the job that writes: documents that break rules leave no table, those that keep all of them are written."""
    docs = FX.table(spark, sf_dir, "documents")
    rules = {"ascii": F.col("text").rlike(r"^[ -~\n]*$"), "english": F.col("lang") == "en", "over_200": F.length("text") > 200}
    path = scratch_path(spark, "checked")
    try:
        V.write_checked(docs, path, rules)
        counts = dict.fromkeys(rules, 0)
    except V.ExpectationError as e:
        counts = e.counts
    good = F.lit(True)
    for c in rules.values():
        good = good & F.coalesce(c, F.lit(False))
    V.write_checked(docs.filter(good), path, rules)
    found = spark.createDataFrame(list(counts.items()), "rule string, violations long")
    return found.unionByName(spark.read.parquet(path).agg(F.lit("rows written").alias("rule"), F.count("*").alias("violations")))


@register("characters_seen", """
SELECT ch, count(*) AS n_texts FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '(?s).'))) AS ch FROM documents) GROUP BY ch""")
def characters_seen(spark, sf_dir):
    """V3: the characters of all documents."""
    return V.characters_seen(FX.table(spark, sf_dir, "documents"), ["text"])
