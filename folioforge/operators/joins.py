"""Joins: keyed, banded, interval, as-of, tiered and one-to-one matches."""

from __future__ import annotations

from folioforge.plans.catalog import operator, view


@operator("jn01_content_features", "items", "headings")
def _(d):
    """Items with their feature row; keys are unique on both sides."""
    return "select i.doc_id, i.seq, h.level, length(h.title) > 0 as titled from items i join headings h on i.doc_id = h.doc_id and i.seq = h.seq"


@view("outline", "headings")
def _(d):
    """Outline entries: page, normalised title and depth."""
    return "select doc_id, page, lower(trim(title)) as normalized_title, level as depth, seq from headings where (doc_id + page) % 2 = 0 and level <= 3"


@view("outline_matches", "headings", "outline")
def _(d):
    """Headings with the state of their outline match."""
    return """select h.doc_id, h.seq, case when coalesce(o.n, 0) = 0 then 'absent' when o.n = 1 then 'unique_exact' else 'ambiguous' end as outline_state, case when o.n = 1 then o.depth end as outline_level
      from headings h left join (select doc_id, page, normalized_title, count(*) as n, min(depth) as depth from outline group by doc_id, page, normalized_title) o
      on h.doc_id = o.doc_id and h.page = o.page and lower(trim(h.title)) = o.normalized_title"""


@operator("jn02_outline_overlay", "outline_matches")
def _(d):
    """Outline state and level of headings."""
    return "select doc_id, seq, outline_state, outline_level from outline_matches"


@view("page_alignment", "items")
def _(d):
    """Lines of a page by normalised text: unique or ambiguous."""
    return """select doc_id, page, norm, case when n = 1 then 'unique_aligned' else 'ambiguous' end as state, case when n = 1 then size end as line_size
      from (select doc_id, page, lower(trim(line)) as norm, count(*) as n, cast(min(length(line)) as bigint) as size from items where trim(line) <> '' group by doc_id, page, lower(trim(line)))"""


@operator("jn03_alignment_lookup", "items", "page_alignment")
def _(d):
    """Alignment state of items."""
    return "select i.doc_id, i.seq, coalesce(a.state, 'absent') as layout_state from items i left join page_alignment a on a.doc_id = i.doc_id and a.page = i.page and a.norm = lower(trim(i.line))"


@view("target_index", "headings", "items")
def _(d):
    """Targets of references: lookup key, type, page, id."""
    return """select doc_id, cast(doc_id % 5 + 1 as string) || '.' || cast(seq % 3 + 1 as string) || case when seq % 4 = 0 then ' ' || lower(title) else '' end as lookup_key, 'section' as target_type, page, 'sec-' || cast(seq as string) as target_id from headings where seq % 2 = 0
      union all select doc_id, 'table ' || cast(seq % 6 + 1 as string), 'table', page, 'tab-' || cast(seq as string) from items where role = 'list_item'
      union all select doc_id, 'page ' || cast(page as string), 'printed_page', page, 'pag-' || cast(page as string) from items where seq % 8 = 0
      union all select doc_id, 'appendix ' || lower(chr(cast(65 + doc_id % 8 as int))), 'appendix', min(page), 'app-0' from items where doc_id % 8 < 4 group by doc_id"""


@view("target_keys", "target_index")
def _(d):
    """Every key under which a target is found: its own, the number that a section's begins with, a page's without the word."""
    other = f"case target_type when 'section' then {d.part('lookup_key', '^[0-9]+(?:[.][0-9]+)*', 0)} when 'printed_page' then case when lookup_key like 'page %' then substr(lookup_key, 6) end end"
    keyed = d.exploded("target_index", "x", d.struct(key="lookup_key"), d.struct(key=other))
    return f"select distinct doc_id, x.key as lookup_key, target_type, page, target_id from {keyed} where x.key <> ''"


TABLE_PAGE_WINDOW = 10


@view("key_matches", "mentions", "target_keys")
def _(d):
    """References with every target of their document and type that has their key, near or not."""
    return """select m.doc_id, m.seq, m.span_start, m.mention_class, m.lookup_key, m.page, t.target_id, t.target_type, t.page as target_page from mentions m join target_keys t
      on t.doc_id = m.doc_id and t.target_type = m.mention_class and t.lookup_key = m.lookup_key"""


@view("mention_candidates", "key_matches")
def _(d):
    """Targets of each reference; tables only within the page window."""
    return f"select doc_id, seq, span_start, mention_class, lookup_key, page, target_id, target_type, target_page from key_matches where mention_class <> 'table' or abs(target_page - page) <= {TABLE_PAGE_WINDOW}"


@operator("jn04_mention_targets", "mention_candidates")
def _(d):
    """Structural keys of references matched with the target index."""
    return "select doc_id, seq, span_start, mention_class, target_id from mention_candidates"


@operator("jn05_table_page_window", "mentions", "target_index")
def _(d):
    """Table references with the distance to targets within the page window."""
    return f"select m.doc_id, m.seq, m.span_start, t.target_id, abs(t.page - m.page) as distance from mentions m join target_index t on t.doc_id = m.doc_id and t.lookup_key = m.lookup_key and t.target_type = 'table' where m.mention_class = 'table' and t.page between m.page - {TABLE_PAGE_WINDOW} and m.page + {TABLE_PAGE_WINDOW}"


@operator("jn06_page_cooccurrence", "table_labels", "page_tables")
def _(d):
    """Label and table of a document's page that has exactly one of each."""
    return """select l.doc_id, l.page, l.seq, t.table_id from (select doc_id, page, min(seq) as seq from table_labels group by doc_id, page having count(*) = 1) l
      join (select doc_id, page, min(table_id) as table_id from page_tables group by doc_id, page having count(*) = 1) t on t.doc_id = l.doc_id and t.page = l.page"""


@operator("jn07_family_catalog", "family")
def _(d):
    """Aliases of other sources of the family, under the role rules."""
    return """select a.source_id, b.source_id as target_source_id, b.alias from family a join family b on a.root_id = b.root_id and a.source_id <> b.source_id
      where b.role <> 'root_report' and (a.role = 'root_report' or b.role = 'top_level_appendix')"""


@operator("jn08_intended_sources", "sources", "family")
def _(d):
    """Intended sources that are present among the targets."""
    return "select f.source_id from family f where exists (select 1 from sources s where s.source_id = f.source_id and s.role = 'model_corpus')"


@operator("jn09_innermost_scope", "items", "regimes")
def _(d):
    """Items with the numbering scope of latest start that covers them."""
    return "select i.doc_id, i.seq, max_by(r.regime_no, r.start_seq) as regime_no from items i join regimes r on r.doc_id = i.doc_id and i.seq >= r.start_seq and i.seq < r.end_seq group by i.doc_id, i.seq"


@operator("jn10_toc_entry_region", "items", "toc_regions")
def _(d):
    """Entries with the region of contents that they lie in."""
    return "select i.doc_id, i.seq, r.start_seq from items i join toc_regions r on r.doc_id = i.doc_id and i.seq > r.start_seq and i.seq <= r.end_seq"


@operator("jn11_preceding_heading", "items")
def _(d):
    """List items under the latest heading before them."""
    w = "partition by doc_id order by seq rows between unbounded preceding and current row"
    return f"select doc_id, seq, heading from (select doc_id, seq, role, {d.last('case when level is not null then seq end', w)} as heading from items) where role = 'list_item'"


@operator("jn12_following_anchor", "items")
def _(d):
    """First heading of level 2 after each level-1 heading."""
    w = "partition by doc_id order by seq rows between 1 following and unbounded following"
    return f"select doc_id, seq, anchor from (select doc_id, seq, level, {d.first('case when level = 2 then seq end', w)} as anchor from items) where level = 1"


@operator("jn13_earlier_anchor", "numbered")
def _(d):
    """Offset of the nearest earlier anchor in the numbering scope."""
    w = "partition by doc_id, regime_no order by seq rows between unbounded preceding and 1 preceding"
    return f"select doc_id, seq, {d.last('anchor_level - depth', w)} as calibration from numbered"


@view("toc_entries", "items")
def _(d):
    """Rows of contents: title, page, order, and the depth of the number that the title begins with, else 1."""
    number = d.part("trim(line)", r"^([0-9]+(?:\.[0-9]+){0,5})\.?[ \t]", 1)
    return f"select doc_id, seq, page, lower(trim(line)) as title, cast(length({number}) - length(replace({number}, '.', '')) + 1 as bigint) as depth from items where role = 'list_item' and trim(line) <> ''"


@view("toc_matches", "toc_entries", "headings")
def _(d):
    """Body headings of contents rows by the first tier that finds any: equal titles, equal without typography, equal to the title that a heading ends with after its appendix, then the next two items."""
    bare = lambda x: d.replace_all(f"lower(trim({x}))", "[-‐‑–—'’]+", "")
    tail = d.part("lower(trim(h.title))", "^appendix [a-z0-9]+[:. -]+(.*)$", 1)
    return f"""select doc_id, seq, target_seq, tier from (select *, min(tier) over (partition by doc_id, seq) as best from (
        select e.doc_id, e.seq, h.seq as target_seq, 1 as tier from toc_entries e join headings h on h.doc_id = e.doc_id and lower(trim(h.title)) = e.title
        union all select e.doc_id, e.seq, h.seq, 2 from toc_entries e join headings h on h.doc_id = e.doc_id and {bare('h.title')} = {bare('e.title')}
        union all select e.doc_id, e.seq, h.seq, 3 from toc_entries e join headings h on h.doc_id = e.doc_id and {tail} = e.title
        union all select e.doc_id, e.seq, h.seq, 4 from toc_entries e join headings h on h.doc_id = e.doc_id and h.seq between e.seq + 1 and e.seq + 2)) where tier = best"""


@operator("jn14_tiered_toc_match", "toc_matches")
def _(d):
    """Matches of contents rows in the first tier that has one."""
    return "select doc_id, seq, target_seq, cast(tier as bigint) as tier from toc_matches"


@operator("jn15_adjacent_tables", "tables")
def _(d):
    """Last table of a page with the first of the next page."""
    return """select a.table_id as last_id, b.table_id as first_id from (select page, max_by(table_id, page_table_index) as table_id from tables group by page) a
      join (select page, min_by(table_id, page_table_index) as table_id from tables group by page) b on b.page = a.page + 1"""


@operator("jn17_point_in_box", "boxes")
def _(d):
    """Boxes whose centre lies in exactly one other box of the record."""
    return """select x.box_id, x.part_no, min(y.part_no) as owner from boxes x join boxes y on x.box_id = y.box_id and x.part_no <> y.part_no
      and (x.l + x.r) / 2 between y.l and y.r and (x.b + x.t) / 2 between y.b and y.t group by x.box_id, x.part_no having count(*) = 1"""


@operator("jn18_tolerant_alignment", "boxes", "aligned_boxes")
def _(d):
    """One-to-one matches of two producers' boxes within half a point, unique both ways."""
    return """select box_id, no_a, no_b from (select box_id, no_a, no_b, count(*) over (partition by box_id, no_a) as na, count(*) over (partition by box_id, no_b) as nb from (
        select x.box_id, x.part_no as no_a, y.part_no as no_b from boxes x join aligned_boxes y
        on x.box_id = y.box_id and x.page = y.page and abs(x.l - y.l) <= 0.5 and abs(x.r - y.r) <= 0.5 and abs(x.b - y.b) <= 0.5 and abs(x.t - y.t) <= 0.5)) where na = 1 and nb = 1"""


@view("baseline_rows", "sources")
def _(d):
    """Earlier version of the sources."""
    return "select source_id, title, pages, role from sources where source_id % 10 <> 0"


@view("candidate_rows", "sources")
def _(d):
    """Later version of the sources."""
    return "select source_id, case when source_id % 7 = 2 then title || ' (revised)' else title end as title, case when source_id % 4 = 0 then pages + 1 else pages end as pages, case when source_id % 6 = 0 then null else role end as role from sources where source_id % 11 <> 0"


@view("row_differences", "baseline_rows", "candidate_rows")
def _(d):
    """Fields that differ between versions, and rows that only one has."""
    both = "baseline_rows a full outer join candidate_rows b on a.source_id = b.source_id"
    both_has = "a.source_id is not null and b.source_id is not null"
    return f"""select coalesce(a.source_id, b.source_id) as source_id, 'row' as field, case when b.source_id is null then 'missing' else 'extra' end as difference from {both} where a.source_id is null or b.source_id is null
      union all select a.source_id, 'pages', 'changed' from {both} where {both_has} and a.pages is distinct from b.pages
      union all select a.source_id, 'role', 'changed' from {both} where {both_has} and a.role is distinct from b.role
      union all select a.source_id, 'title', 'changed' from {both} where {both_has} and a.title is distinct from b.title"""


@operator("jn19_row_comparison", "row_differences")
def _(d):
    """Missing, extra and changed fields between two versions."""
    return "select source_id, field, difference from row_differences"


@operator("jn20_file_comparison", "tree_a", "tree_b")
def _(d):
    """Files of two trees compared by path and digest, one path ignored."""
    return """select coalesce(a.href, b.href) as path, case when b.href is null then 'missing' when a.href is null then 'extra' when a.digest <> b.digest then 'changed' else 'equal' end as state
      from tree_a a full outer join tree_b b on a.href = b.href where coalesce(a.href, b.href) <> '/index.html'"""


@operator("jn21_unresolved_references", "mentions", "target_keys")
def _(d):
    """References whose key no target of the document has."""
    return "select m.doc_id, m.seq, m.span_start, m.lookup_key from mentions m where not exists (select 1 from target_keys t where t.doc_id = m.doc_id and t.lookup_key = m.lookup_key)"


@operator("jn22_region_clean_table", "boxes", "accepted_regions", "tables")
def _(d):
    """Regions with their clean table or the reason why there is none."""
    reason = "case when t.table_id is not null then null when b.page % 5 = 0 then 'full_page_numeric_route' else 'no_clean_table_match' end as reason"
    if d.name == "spark":  # keys of regions that no parser matched are null: joined by them, tables would meet two thirds of the regions in one task
        pages = d.dealt("(select box_id, part_no, cast(part_no as bigint) as place, min(page) as page from boxes group by box_id, part_no)", "box_id", "place")
        accepted = d.dealt("(select box_id, cast(part_no as bigint) as place from accepted_regions)", "box_id", "place")
        return f"""select b.box_id, b.part_no, t.table_id, {reason} from {pages} b
      left join (select a.box_id, a.place, t.table_id from {accepted} a join {d.dealt('tables', 'table_id', 'page_table_index')} t on t.table_id = a.box_id and t.page_table_index = a.place) t on t.box_id = b.box_id and t.place = b.place"""
    return f"""select b.box_id, b.part_no, t.table_id, {reason}
      from (select box_id, part_no, min(page) as page from boxes group by box_id, part_no) b left join accepted_regions a on a.box_id = b.box_id and a.part_no = b.part_no
      left join tables t on t.table_id = a.box_id and t.page_table_index = a.part_no"""


@operator("jn24_grid_completeness", "cells")
def _(d):
    """Grid places of small tables without a cell."""
    grid = d.series("(select table_id, max(r) as rows_ from cells group by table_id)", "r", "1", "rows_")
    return f"select g.table_id, g.r, k.c from {grid} g cross join (select distinct c from cells) k where not exists (select 1 from cells x where x.table_id = g.table_id and x.r = g.r and x.c = k.c and x.text <> '')"


@operator("jn25_caption_blocks", "items")
def _(d):
    """Captions by owner in order, those without a valid place left out."""
    return f"select doc_id, owner, {d.listagg('cast(seq as string)', 'seq')} as caption_ids from (select doc_id, seq, seq - seq % 8 as owner from items where role = 'list_item' and trim(line) <> '') group by doc_id, owner"


@operator("jn26_producer_bridge", "items", "headings")
def _(d):
    """Every item with its block or its disposition; the disposition wins."""
    return """select i.doc_id, i.seq, case when i.role = 'page_footer' then 'furniture' end as disposition, case when i.role <> 'page_footer' then 'blk-' || cast(i.seq as string) end as block_id, h.seq is not null as is_heading
      from items i left join headings h on h.doc_id = i.doc_id and h.seq = i.seq"""


@operator("jn27_replacement_causes", "replacements")
def _(d):
    """Why a text was replaced: under a figure before under a table before an invalid region."""
    return "select doc_id, seq, min_by(cause, case cause when 'figure' then 1 when 'table' then 2 else 3 end) as cause from replacements group by doc_id, seq"


@operator("jn28_attach_by_page", "page_tables", "body_events")
def _(d):
    """Whole-page tables after the last body event of their document whose page is not beyond theirs; -1 is the front. One ordered pass."""
    w = "partition by doc_id order by page, is_table rows between unbounded preceding and current row"
    return f"""select doc_id, table_id, coalesce(after_seq, -1) as after_seq from (select doc_id, table_id, is_table, max(seq) over ({w}) as after_seq
      from (select doc_id, page, 1 as is_table, table_id, cast(null as bigint) as seq from page_tables union all select doc_id, page, 0, null, seq from body_events)) where is_table = 1"""


@operator("jn29_table_event_coverage", "tables", "grid")
def _(d):
    """Tables and events that do not meet exactly once."""
    return "select coalesce(t.table_id, e.table_id) as table_id, coalesce(e.n, 0) as events from tables t full outer join (select table_id, count(*) as n from grid where r = 1 group by table_id) e on e.table_id = t.table_id where t.table_id is null or e.n is distinct from 1"


@operator("jn30_selection_manifest", "selection", "manifest_sources")
def _(d):
    """Differences between a frozen selection and the manifest."""
    return "select coalesce(a.source_id, b.source_id) as source_id, a.source_id is null as only_manifest from selection a full outer join manifest_sources b on a.source_id = b.source_id where a.source_id is null or b.source_id is null"


@operator("jn31_identity_changes", "candidates", "later_candidates")
def _(d):
    """Identity fields that changed between a source's candidate and the later one."""
    return """select a.source_id, 'terminal_state' as field from candidates a join later_candidates b on a.source_id = b.source_id where a.terminal_state is distinct from b.terminal_state
      union all select a.source_id, 'failure_class' from candidates a join later_candidates b on a.source_id = b.source_id where a.failure_class is distinct from b.failure_class"""
