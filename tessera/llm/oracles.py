"""DuckDB statements for the operators whose results SQL can state; see also the modules of the native ones."""

from __future__ import annotations

import math

from tessera.llm import secrets as S
from tessera.llm.decontaminate import WINDOW

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decontamination() -> str:
    pattern = _q(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {pattern})"
    return f"""
with d as (select row_number() over () as i, doc_id, {words} as w from documents),
b as (select item_id, {words} as w from benchmark),
bw as (select distinct item_id, least(len(w), {WINDOW}) as n, unnest(list_transform(range(greatest(len(w) - {WINDOW}, 0) + 1), lambda a: array_to_string(w[a + 1:a + {WINDOW}], ' '))) as x from b where len(w) > 0),
lengths as (select distinct n from bw),
dw as (select i, n, unnest(range(len(w) - n + 1)) as a, unnest(list_transform(range(len(w) - n + 1), lambda a: array_to_string(w[a + 1:a + n], ' '))) as x from d, lengths where len(w) >= n),
hits as (select distinct dw.i, dw.a, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.x = bw.x),
covered as (select i, count(distinct p) as n_hit from (select i, unnest(range(a, a + n)) as p from hits) group by i),
items as (select i, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct i, coalesce(cast(item_id as varchar), '') as s from hits) group by i)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered on d.i = covered.i left join items on d.i = items.i
"""


def near_duplicates(width: int = 3, percent: int = 85) -> str:
    return f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(len(w) - {width - 1}), lambda a: array_to_string(w[a + 1:a + {width}], ' '))) end as s from w),
x as (select doc_id, unnest(s) as g from s),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
half as (select a, b from common join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * n >= {percent} * (len(sa.s) + len(sb.s) - n)),
link as (select a, b from half union all select b, a from half),
reach as (select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join link l on r.b = l.a)
select s.doc_id, len(s.s) as n_shingles, min(r.b) as component_id, min(r.b) = s.doc_id as kept from s join reach r on r.a = s.doc_id group by s.doc_id, s.s
"""


def secrets() -> str:
    def found(pattern: str, group: int, least: int, kind: int) -> str:
        p = _q(pattern)
        return f"""select i, s, s + len(h) as e, {kind} as k, h from (
  select i, h, g, sum(len(pre)) over (partition by i order by n) + coalesce(sum(len(h)) over (partition by i order by n rows between unbounded preceding and 1 preceding), 0) as s
  from (select i, unnest(hits) as h, unnest(groups) as g, unnest(parts[1:len(hits)]) as pre, generate_subscripts(hits, 1) as n from (
    select i, regexp_extract_all(t, {p}, 0) as hits, regexp_extract_all(t, {p}, {group}) as groups, string_split_regex(t, {p}) as parts from d))) where len(g) >= {least}"""

    base = "\nunion all ".join(found(p, g, n, S.KINDS.index(k)) for k, (p, g, n) in S.BASE.items())
    limit = " ".join(f"when regexp_matches(h, {_q(p)}) then {bits}" for p, bits in S.CLASSES.values())
    allowed = " or ".join(f"regexp_matches(h, {_q(p)})" for p in S.ALLOWED)
    n, table = S.WINDOW, "[" + ", ".join(map(str, S.SUMS)) + "]"
    least = (f"list_min(list_transform(range(len(h) - {n - 1}), lambda a: list_sum(list_transform(list_distinct(string_split(substr(h, a + 1, {n}), '')), "
             f"lambda c: {table}[{n + 1} - len(replace(substr(h, a + 1, {n}), c, ''))]))))")
    names = "[" + ", ".join(map(_q, S.KINDS)) + "]"
    joined = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' order by s, k, e)"
    counts = ", ".join(f"count(*) filter (where k = {S.KINDS.index(k)}) as n_{k}" for k in S.KINDS)
    return f"""
with d as (select row_number() over () as i, doc_id, coalesce(text, '') as t from documents),
base as ({base}),
near as ({found(S.CANDIDATE, 0, n, 3)}),
more as (select * from near where not ({allowed}) and {round(math.log2(n) * 1e6 * n)} - {least} >= case {limit} end * {n}
  and not exists (select 1 from base where base.i = near.i and base.s <= near.s and base.e >= near.e)),
spans as (select i, s, e, k from base union all select i, s, e, k from more),
c as (select i, {counts}, {joined} filter (where k < 3) as b, {joined} as a from spans group by i)
select doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in S.KINDS)}, sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans from d left join c on d.i = c.i
"""
