"""Main text of pages by a site style tree.

The DOMs of a host's pages are merged into a style tree: an element node is
known by its place, and the child sequences it shows on different pages are its
presentations. A node's own importance is the entropy of its presentations (of
its texts, for a block of text) over the m pages that have it, with m as the
base: 1 if every page shows another one, 0 if all show the same. The composite
importance of an inner node with l presentations is
(1 - g^l) * own + g^l * (mean over pages of the mean importance of the children
of their presentation). Branches on at least ``MIN_PAGES`` pages in which no
node has a composite importance of ``LEAST`` are removed from each page.

What a page says about itself is the prior: elements marked as menus, footers,
sidebars, notices, adverts, forms, comments, scripts and so on have importance
0; where a page marks its article, that branch has importance 1 and what stands
beside it 0. Entropy decides for everything else, also for unmarked branches
inside an article, which stays whole where all of it would go. So copies of one
article on one host don't make it a template.

A page's tree is read in its task. Counts are partial sums, and the levels of
the tree are worked upwards by joins on nodes, so a host with a third of all
pages is no single task. Removed branches are rows (host, node), joined to the
nodes that a page's walk asks about, so a row holds at most the nodes of a page.
Only pages that may have removed branches are shuffled.

Defined cases: null, empty or textless html gives the empty text; pages with no
host in the url are judged by their marks alone; repeated pages count each; an
empty table gives no rows. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.dom import MAYBE, NOISE, TEXT, Node, parse
from tessera.llm.line_dedup import host_of
from tessera.llm.tables import scratch, stored

DAMPING = 0.9
LEAST = 0.3
MIN_PAGES = 5
SLOTS = 1 << 20

NODES = "host string, level int, style bigint, node bigint, value bigint"


def key(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)))


def text_nodes(root: Node) -> list[Node]:
    """Branches that the page marks as its article: articles, or else main elements, outside of noise.

    If all stand inside something that a class calls noise, that class is the
    wrapper's, and the longest of them is the article.
    """
    found: dict[tuple[bool, str], list[Node]] = {}
    todo = [(root, False)]
    while todo:
        x, doubtful = todo.pop()
        if x.mark == NOISE:
            continue
        doubtful = doubtful or x.mark == MAYBE
        if x.mark == TEXT:
            found.setdefault((doubtful, "main" if x.tag == "main" else "article"), []).append(x)
            if x.tag != "main":
                continue
        todo += [(c, doubtful) for c in reversed(x.children) if not isinstance(c, str)]
    for kind in ("article", "main"):
        if found.get((False, kind)):
            return found[False, kind]
        if found.get((True, kind)):
            return [max(found[True, kind], key=lambda x: sum(map(len, kept(x))))]
    return []


def kept(node: Node) -> list[str]:
    """Texts below an article, in page order, without marked noise."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.mark not in (NOISE, MAYBE):
            todo += reversed(x.children)
    return out


def is_noise(node: Node) -> bool:
    """Marked as noise; a form around the page's heading is a wrapper."""
    if node.mark == MAYBE and node.tag == "form":
        todo = [c for c in node.children if not isinstance(c, str)]
        while todo:
            x = todo.pop()
            if x.tag == "h1":
                return False
            todo += [c for c in x.children if not isinstance(c, str)]
    return node.mark < 0


def labels(children: list) -> list[str]:
    return [c.label if not isinstance(c, str) else "#text" for c in children]


def shown_keys(root: Node) -> dict[int, int]:
    """Key of the presentation of every element, by its ``id``."""
    out: dict[int, int] = {}
    todo = [(root, 1)]
    while todo:
        x, own = todo.pop()
        shown = out[id(x)] = key(own, *labels(x.children))
        todo += [(c, key(shown, i)) for i, c in enumerate(x.children) if not isinstance(c, str)]
    return out


def tree_rows(root: Node, out: list[tuple[int, int, int, int]]) -> None:
    """(level, style it is a child of, node, presentation or text) of every node with text in it."""
    todo = [(root, 0, 1, 0)]
    while todo:
        node, style, own, level = todo.pop()
        shown = key(own, *labels(node.children))
        out.append((level, style, own, shown))
        for i, c in enumerate(node.children):
            child = key(shown, i)
            if isinstance(c, str):
                out.append((level + 1, shown, child, key(c)))
            else:
                todo.append((c, shown, child, level + 1))


def main_text(root: Node, removed: set[int], asked: list[int] | None = None) -> str:
    """Blocks of a page whose branches are kept, one a line; ``asked`` gets the branches that ``removed`` is asked for."""
    shown = shown_keys(root)

    def walk(todo: list[tuple], noise: Callable[[Node], bool]) -> list[str]:
        out: list[str] = []
        while todo:
            x, own = todo.pop()
            element = not isinstance(x, str)
            if element and noise(x):
                continue
            if not element or x.mark in (0, MAYBE):
                if asked is not None:
                    asked.append(own)
                if own in removed:
                    continue
            if element:
                todo += below(x)
            else:
                out.append(x)
        return out

    def below(x: Node) -> list[tuple]:
        return [(c, key(shown[id(x)], i)) for i, c in reversed(list(enumerate(x.children)))]

    out: list[str] = []
    for x in text_nodes(root):
        # an article that would go as a whole is one of several copies
        out += walk(below(x), lambda c: c.mark in (NOISE, MAYBE)) or kept(x)
    return "\n".join(out or walk([(root, 1)], is_noise))


def nodes(pages: DataFrame) -> DataFrame:
    """NODES rows of all pages that have a host."""
    schema = T._parse_datatype_string(NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, rows = [], []
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                before = len(rows)
                tree_rows(parse(html.as_py()), rows)
                hosts += [host.as_py()] * (len(rows) - before)
            level, *keys = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(level, pa.int32()), *(pa.array(np.array(k, np.uint64).view(np.int64)) for k in keys)], names=schema.names)

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null and html is not null")
    return rows.mapInArrow(run, schema)


def importance(tree: DataFrame) -> DataFrame:
    """(host, node, m, importance, best) of every node of the merged trees; best: the highest importance in its branch."""
    values = stored(tree.groupBy("host", "level", "style", "node", "value").agg(F.count(F.lit(1)).alias("c")), "style-tree")
    own = F.when(F.col("m") > 1, 1 - F.col("q") / (F.col("m") * F.log(F.col("m").cast("double")))).otherwise(F.lit(1.0))
    stats = values.groupBy("host", "level", "style", "node").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("q"), F.count(F.lit(1)).alias("l"))
    stats = stored(stats.select("host", "level", "style", "node", "m", "l", own.alias("own")), "style-nodes")
    # what only one page has is of importance 1, as is all below it
    deepest = stats.where("m > 1").agg(F.max("level")).first()[0]
    done: DataFrame | None = None
    below: DataFrame | None = None
    for level in range(deepest + 1 if deepest is not None else -1, -1, -1):
        here = stats.where(F.col("level") == level)
        if below is None:
            here = here.select("host", "style", "node", "m", F.col("own").alias("importance"), F.col("own").alias("best"))
        else:
            # mean importance of the children that a presentation has, then its mean over pages
            shown = below.groupBy("host", "style").agg(F.avg("importance").alias("mean"), F.max("best").alias("top")).withColumnRenamed("style", "value")
            inner = values.where(F.col("level") == level).join(shown, ["host", "value"])
            inner = inner.groupBy("host", "node").agg((F.sum(F.col("c") * F.col("mean")) / F.sum("c")).alias("inner"), F.max("top").alias("top"))
            weight = F.pow(F.lit(DAMPING), F.col("l").cast("double"))
            composite = F.when(F.col("inner").isNull(), F.col("own")).otherwise((1 - weight) * F.col("own") + weight * F.col("inner"))
            here = here.join(inner, ["host", "node"], "left").select(
                "host", "style", "node", "m", composite.alias("importance"), F.greatest(composite, "top").alias("best"))
        below = stored(here, f"importance-{level}")
        done = below if done is None else done.unionByName(below)
    if done is None:
        return stats.select("host", "node", "m", F.col("own").alias("importance"), F.col("own").alias("best"))
    return done.select("host", "node", "m", "importance", "best")


def asked_branches(pages: DataFrame) -> DataFrame:
    """(host, page, node): the branches that each page's walk asks about; page hashes the html."""
    schema = T._parse_datatype_string("host string, page bigint, node bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for i, html in enumerate(batch.column(2)):
                before = len(keys)
                main_text(parse(html.as_py()), set(), keys)
                at += [i] * (len(keys) - before)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), pa.array(np.array(keys, np.uint64).view(np.int64))], names=schema.names)

    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html").where("host is not null and html is not null")
    return rows.mapInArrow(run, schema)


def removed_branches(pages: DataFrame) -> DataFrame:
    """(host, page, removed): keys of the low-importance branches of each page that has some."""
    low = stored(importance(nodes(pages)).where((F.col("best") < LEAST) & (F.col("m") >= MIN_PAGES)).select("host", "node"), "low-branches")
    return asked_branches(pages).join(low, ["host", "node"]).groupBy("host", "page").agg(F.collect_set("node").alias("removed"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row a page."""
    with scratch(pages.sparkSession, "style-tree"):
        low = stored(removed_branches(pages), "removed-branches", keep=True).withColumnsRenamed({"host": "_host", "page": "_page"})
    # pages without removed branches don't leave their scan: a broadcast of at most SLOTS numbers
    numbers = F.broadcast(low.select(F.pmod("_page", F.lit(SLOTS)).alias("number")).distinct())
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    rows = rows.withColumn("number", F.pmod("page", F.lit(SLOTS)))
    maybe = rows.join(numbers, "number", "left_semi").join(low, (F.col("host") == F.col("_host")) & (F.col("page") == F.col("_page")), "left")
    rest = rows.join(numbers, "number", "left_anti").withColumn("removed", F.lit(None).cast("array<bigint>"))
    rows = maybe.select("page_id", "url", "html", "removed").union(rest.select("page_id", "url", "html", "removed"))
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, low in zip(batch.column(2), batch.column(3), strict=True):
                keys = set(np.asarray(low.values).view(np.uint64).tolist()) if low.is_valid else set()
                texts.append(main_text(parse(html.as_py()), keys) if html.is_valid else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
