"""Connected components of a link table, by contraction.

Each round points every node at its smallest neighbour (nodes are ordered by a
digest, so pointer chains are short whatever the ids), follows the pointers to
their ends, and contracts the links. The number of linked nodes at least
halves every other round. Links and labels stay distributed; rounds are cut by
reliable checkpoints. Neighbour minima are partial aggregates, so a node
with a third of all links is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import stored


def _followed(step: DataFrame) -> DataFrame:
    """Pointers (v, to) with ``to`` at the end of its chain; ends point at themselves."""
    while True:
        b = step.select(F.col("v").alias("_v"), F.col("to").alias("_to"))
        jumped = stored(step.join(b, step["to"] == b["_v"], "left").select(
            "v", F.coalesce("_to", "to").alias("to"), (F.col("_to") != F.col("to")).alias("moved")), "chains")
        moved = jumped.where("moved").limit(1).count()
        step = jumped.select("v", "to")
        if not moved:
            return step


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every node of ``links`` (a, b); all nodes of a component have one root.

    No links give no rows; self links and repeated links change nothing.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # by digest, then by node: a total order, and one that is no long chain
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min(order("b")).alias("m"))
        step = stored(least.select("v", F.least(F.col("m"), order("v"))["n"].alias("to")), "pointers")
        ends = _followed(step)
        if labels is None:
            labels = stored(ends.select("v", F.col("to").alias("root")), "labels")
        else:
            e = ends.select(F.col("v").alias("_v"), F.col("to").alias("_to"))
            labels = stored(labels.join(e, labels["root"] == e["_v"], "left").select("v", F.coalesce("_to", "root").alias("root")), "labels")
        ea = ends.select(F.col("v").alias("a"), F.col("to").alias("ra"))
        eb = ends.select(F.col("v").alias("b"), F.col("to").alias("rb"))
        edges = stored(edges.join(ea, "a").join(eb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
