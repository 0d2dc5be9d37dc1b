"""Line deduplication by site-relative frequency.

The lines of a page are the texts between its block tags. A line's frequency is
the share of its host's pages that hold it; a line on more than ``ratio`` of
them, and on at least ``min_pages``, is boilerplate of that host and leaves all
of its pages. Boilerplate is taken from counts over all pages: lines are
counted once a page, in partial sums, so a host with a third of all pages is
summed up before the shuffle. A host's boilerplate lines are one row: there are
at most (lines a page) / ratio of them.

Everything is DataFrame work; no Python runs on rows.

Defined cases: null html has no lines and gives empty text; pages whose url is
null or names no host are no site and keep all lines; an empty line isn't
kept; repeated rows are pages like others; a line that occurs twice in a page
counts once and leaves or stays with both; an empty table gives no rows. Other
columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import stored

RATIO = 0.3
MIN_PAGES = 3

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
HIDDEN = r"(?is)<(?:script|style)\b.*?</(?:script|style)[^>]*>|<!--.*?-->"
INLINE = r"(?i)</?(?:a|abbr|b|cite|code|em|font|i|mark|small|span|strong|sub|sup|u)(?:\s[^>]*)?>"
TAG = r"<[^>]*>"
BLANKS = r"[ \t\r\f]+"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """Texts between block tags and line feeds, blanks run together, empty ones left out."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n"), INLINE, ""), TAG, "\n")
    lines = F.split(F.regexp_replace(text, BLANKS, " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): digests of the lines of each host that are on too many of its pages."""
    rows = pages.select(host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")).where("host is not null")
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    held = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("line"))
    often = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    over = often.join(total, "host").where(F.col("n") > ratio * F.col("n_pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("often"))


def line_deduplicated(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, host, n_lines, n_dropped, text), one row a page; text joins the lines that stay with line feeds."""
    drop = stored(boilerplate(pages, ratio, min_pages), "boilerplate").withColumnRenamed("host", "_host")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    both = rows.join(drop, F.col("host") == F.col("_host"), "left")
    stay = F.when(F.col("often").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("often", F.unhex(F.md5(x)))))
    return both.select("page_id", "url", "host", F.size("lines").cast("long").alias("n_lines"), stay.alias("stay"), "lines").select(
        "page_id", "url", "host", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = f"""
with p as (select row_number() over () as i, page_id, url, nullif(lower(regexp_extract(url, {_q(HOST)}, 1)), '') as host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    {_q(HIDDEN)}, chr(10), 'g'), {_q(INLINE)}, '', 'g'), {_q(TAG)}, chr(10), 'g'), {_q(BLANKS)}, ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from pages),
total as (select host, count(*) as n_pages from p where host is not null group by host),
held as (select host, unnest(list_distinct(lines)) as line from p where host is not null),
often as (select h.host, line from held h join total t on h.host = t.host group by h.host, line, n_pages having count(*) >= {MIN_PAGES} and count(*) > {RATIO} * n_pages),
a as (select i, page_id, url, host, unnest(lines) as line, generate_subscripts(lines, 1) as k from p),
b as (select a.i, string_agg(a.line, chr(10) order by k) as text, count(*) as n from a left join often o on a.host = o.host and a.line = o.line where o.line is null group by a.i)
select page_id, url, host, len(lines) as n_lines, len(lines) - coalesce(n, 0) as n_dropped, coalesce(text, '') as text from p left join b on p.i = b.i
"""
