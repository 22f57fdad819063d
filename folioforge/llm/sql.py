"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from folioforge.llm.secrets import BASE_KINDS, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


DECONTAMINATION = f"""
with iw as (select distinct item, array_to_string(w[j:j + 12], ' ') as win, len(w[j:j + 12]) as n
    from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as j from (select cast(item_id as varchar) as item, {words('text', ALNUM)} as w from benchmark where item_id is not null) where len(w) > 0)),
d as (select row_number() over () as rid, doc_id, {words('text', ALNUM)} as w from documents),
dw as (select rid, p, n, array_to_string(w[p:p + n - 1], ' ') as win from (select d.rid, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) as p from d, (select distinct n from iw) s where len(d.w) >= s.n)),
hits as (select dw.rid, dw.p, dw.n, iw.item from dw join iw on dw.win = iw.win and dw.n = iw.n),
covered as (select rid, count(distinct pos) as n_hit from (select distinct rid, unnest(range(p, p + n)) as pos from hits) group by rid),
placed as (select row_number() over () as iid, w from (select {words('text', ALNUM)} as w from benchmark where item_id is not null) where len(w) > 0),
jw as (select iid, j, len(w[j:j + 12]) as n, array_to_string(w[j:j + 12], ' ') as win from (select iid, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as j from placed)),
steps as (select dw.rid, dw.p, dw.n, jw.iid, dw.p - jw.j as diagonal from dw join jw on dw.win = jw.win and dw.n = jw.n),
runs as (select rid, min(p) as p, count(*) + max(n) - 1 as size from (select *, p - row_number() over (partition by rid, iid, n, diagonal order by p) as island from steps) group by rid, iid, n, diagonal, island),
longest as (select rid, max(size) as longest_match, arg_min(p - 1, size * -1000000000 + p) as longest_at from runs group by rid),
found as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(longest_match, 0) as longest_match, longest_at
from d left join covered using (rid) left join found using (rid) left join longest using (rid)
"""

NEAR_DUPLICATES = f"""
with recursive d as (select doc_id, {words('text', SPACED)} as w from documents where doc_id is not null),
s as (select distinct doc_id, hash(case when len(w) >= 5 then array_to_string(w[j:j + 4], ' ') else array_to_string(w, ' ') end, least(len(w), 5)) as h from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as j from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) as component_id
from d left join n using (doc_id) left join (select x as doc_id, min(y) as y from reach group by x) m using (doc_id)
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL = f"""
with d as (select row_number() over () as rid, doc_id, {words('text', TERM)} as w from documents),
t as (select rid, term, count(*) as tf from (select rid, unnest(w) as term from d) group by rid, term),
s as (select count(*) as n_docs, sum(len(w)) as total from d where len(w) > 0),
q as (select distinct iid, item_id, unnest({words('text', TERM)}) as term from (select row_number() over () as iid, item_id, text from (select distinct item_id, text from benchmark))),
f as (select term, cast(floor(1000 * ln((2.0 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as weight from t, s where term in (select term from q) group by term, n_docs),
scored as (select q.iid, q.item_id, d.doc_id, d.rid, cast(sum(f.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + (90 * len(d.w) * s.n_docs) // s.total)))) as bigint) as score
  from q join f using (term) join t using (term) join d on d.rid = t.rid, s group by q.iid, q.item_id, d.doc_id, d.rid),
ranked as (select *, row_number() over (partition by iid order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""


def _secrets() -> str:
    parts = []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        size = f"length(regexp_extract(m[i], '{p}', {group}))" if group else "length(m[i])"
        parts.append(f"""select rid, {k} as rule, '{kind}' as kind, start_, start_ + length(m[i]) as end_ from (select rid, m, i, {size} as size,
          list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start_
          from (select rid, m, pieces, unnest(range(1, len(m) + 1)) as i from (select rid, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as pieces from d))) where size >= {least}""")
    counts = ", ".join(f"count(*) filter (where rule = {k}) as n_{RULES[k][0]}" for k in range(BASE_KINDS))
    span = "kind || ':' || start_ || ':' || end_"
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), found as ({' union all '.join(parts)}),
      g as (select rid, {counts}, string_agg(case when rule < {BASE_KINDS} then {span} end, ',' order by start_, rule) as base, string_agg({span}, ',' order by start_, rule) as spans from found group by rid)
      select doc_id, {', '.join(f'coalesce(n_{RULES[k][0]}, 0) as n_{RULES[k][0]}' for k in range(BASE_KINDS))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (rid)"""


ORACLE_SQL: dict[str, str] = {"op3_decontamination": DECONTAMINATION, "op9_ngram_jaccard": NEAR_DUPLICATES, "op10_secret_ledger": _secrets(), "op12_lexical_search": LEXICAL}
