"""Trees, closures, rule cascades and assembly of sections."""

from __future__ import annotations

from folioforge.plans.catalog import operator, view


@view("heading_tree", "heading_parents")
def _(d):
    """Headings as a tree over keys; a third is replaced and skipped."""
    return "select doc_id * 4294967296 + seq as id, case when parent_seq is not null then doc_id * 4294967296 + parent_seq end as parent_id, (doc_id + seq) % 3 = 0 as replaced from heading_parents"


@operator("grf06_family_chains", "headers")
def _(d):
    """Runs of neighbouring tables with equal headers: chains as islands."""
    return "select header, min(table_id) as first_id, max(table_id) as last_id, count(*) as members from (select table_id, header, table_id - row_number() over (partition by header order by table_id) as island from headers) group by header, island having count(*) > 1"


@operator("grf07_scope_forest", "scopes")
def _(d):
    """Parent of a scope: the smallest one that holds it."""
    return f"""select a.doc_id, a.s, a.e, max_by(b.s, {d.row('b.s', '-b.e')}) as parent_start from scopes a left join scopes b on b.doc_id = a.doc_id and b.s <= a.s and b.e >= a.e and (b.s < a.s or b.e > a.e)
      group by a.doc_id, a.s, a.e"""


@view("scopes", "headings")
def _(d):
    """Nested scopes of documents: from a heading over as many items as its level allows."""
    return "select distinct doc_id, seq - seq % case level when 1 then 16 when 2 then 8 when 3 then 4 else 2 end as s, seq - seq % case level when 1 then 16 when 2 then 8 when 3 then 4 else 2 end + case level when 1 then 16 when 2 then 8 when 3 then 4 else 2 end as e from headings"


@operator("grf11_fringe_fixpoint", "boxes")
def _(d):
    """Parts reached from a record's top part through overlapping vertical extents: in order of their tops, reach ends where a top lies below all bottoms so far."""
    w = "partition by box_id order by t desc, b, part_no rows between unbounded preceding"
    return f"""select box_id, count(distinct part_no) as parts from (select box_id, part_no, sum(gap) over ({w} and current row) as gaps
      from (select box_id, part_no, t, b, case when t < min(b) over ({w} and 1 preceding) then 1 else 0 end as gap from boxes)) where gaps = 0 group by box_id"""


@view("rule_evidence", "items", "outline_matches", "parsed_numbers", "toc_targets", "toc_regions", "calibrated", "win02_previous_numbered_level", "win17_first_indented_item", "flt17_sibling_pattern", "level_transfers")
def _(d):
    """Evidence of items for the rule cascade."""
    return """select i.doc_id, i.seq, i.role, i.layer, i.level, i.in_picture, coalesce(o.outline_state, 'absent') as outline_state, o.outline_level, n.kind as numbering_kind, e.doc_id is not null as toc_target, e.depth as toc_level, r.doc_id is not null as toc_region,
        c.calibrated_level, c.root_level, v.previous_level, w.item as indented_item, coalesce(s.sibling, false) as sibling, t.doc_id is not null as transfer, t.level as transfer_level
      from items i left join outline_matches o on o.doc_id = i.doc_id and o.seq = i.seq left join parsed_numbers n on n.doc_id = i.doc_id and n.seq = i.seq left join (select doc_id, target_seq, min(depth) as depth from toc_targets group by doc_id, target_seq) e on e.doc_id = i.doc_id and e.target_seq = i.seq
      left join toc_regions r on r.doc_id = i.doc_id and i.seq between r.start_seq and r.end_seq left join calibrated c on c.doc_id = i.doc_id and c.seq = i.seq left join win02_previous_numbered_level v on v.doc_id = i.doc_id and v.seq = i.seq
      left join win17_first_indented_item w on w.doc_id = i.doc_id and w.seq = i.seq left join flt17_sibling_pattern s on s.doc_id = i.doc_id and s.seq = i.seq
      left join level_transfers t on t.doc_id = i.doc_id and i.seq between t.first_seq and t.last_seq and i.role = 'section_header' and n.kind = 'none'"""


# Rules of the cascade in order. Those from R02 to R07 hold for items of the body only, outside contents and pictures.
RULES = {
    "R01": "not (in_picture and role = 'caption') and (layer = 'furniture' or toc_region or in_picture)",
    "R02": "role = 'section_header' and numbering_kind = 'bullet' and outline_state <> 'unique_exact' and not toc_target",
    "R03": "outline_state = 'unique_exact'",
    "R04": "toc_target",
    "R05": "calibrated_level is not null",
    "R06": "sibling",
    "R07": "transfer",
    "R08": "true",
}
BODY = "layer = 'body' and not toc_region and not in_picture"
JUMP = "(previous_level is null and calibrated_level <> root_level or previous_level is not null and calibrated_level > previous_level + 1)"


@view("decisions", "rule_evidence")
def _(d):
    """Eligible rules of an item in order, and the first of them."""
    eligible = " || ".join(f"case when {c if r in ('R01', 'R08') else f'{BODY} and ({c})'} then '{r} ' else '' end" for r, c in RULES.items())
    return f"select *, substr(eligible, 1, 3) as selected from (select *, trim({eligible}) as eligible from rule_evidence)"


@operator("grf12_rule_cascade", "decisions")
def _(d):
    """Selected rule, all eligible rules, and the decision: role, level and whether it was applied, is ambiguous, or leaves the item as it was."""
    return f"""select doc_id, seq, eligible, selected,
      case when selected = 'R01' then 'excluded' when selected in ('R03', 'R04') or (selected = 'R05' and not {JUMP}) or (selected = 'R07' and transfer_level is not null) or (selected = 'R08' and layer = 'body' and role = 'section_header' and level between 1 and 6) then 'heading' else 'content' end as role,
      case when selected = 'R03' then outline_level when selected = 'R04' then toc_level when selected = 'R05' and not {JUMP} then calibrated_level when selected = 'R07' then transfer_level when selected = 'R08' and layer = 'body' and role = 'section_header' and level between 1 and 6 then level end as corrected_level,
      case when selected = 'R08' then 'unchanged' when selected = 'R06' or (selected = 'R02' and indented_item is null) or (selected = 'R05' and {JUMP}) or (selected = 'R07' and transfer_level is null) then 'ambiguous' else 'applied' end as outcome from decisions"""


@view("direct_content", "items", "heading_parents")
def _(d):
    """Body items with the section that they stand in, that of the latest heading; a heading is the first content of its own."""
    section = d.last("h.seq", "partition by i.doc_id order by i.seq rows between unbounded preceding and current row")
    return f"select doc_id, section, seq from (select i.doc_id, i.seq, i.layer, {section} as section from items i left join heading_parents h on h.doc_id = i.doc_id and h.seq = i.seq) where layer = 'body' and section is not null"


@operator("grf14_ordered_children", "direct_content", "heading_parents")
def _(d):
    """Direct content and child sections of a section in document order."""
    return f"""select doc_id, parent_seq, {d.listagg("kind || ':' || cast(seq as string)", 'seq')} as children from (select doc_id, section as parent_seq, seq, 'content' as kind from direct_content
      union all select doc_id, parent_seq, seq, 'section' from heading_parents where parent_seq is not null) group by doc_id, parent_seq"""


@operator("grf15_text_owners", "cells", "grid")
def _(d):
    """Cells with the row that owns their text."""
    return "select c.table_id, c.r, cast(c.c as bigint) as c, g.l_partkey as owner from cells c join grid g on g.table_id = c.table_id and g.r = c.r where c.c = 4 and c.text <> ''"


@view("spans", "items")
def _(d):
    """Competing spans of an item: three with overlaps."""
    return """select doc_id, seq, kind, s, e from (select doc_id, seq, 'a' as kind, seq % 7 as s, seq % 7 + 5 as e from items union all select doc_id, seq, 'b', seq % 7 + 3, seq % 7 + 3 + doc_id % 20 + 1 from items
      union all select doc_id, seq, 'c', seq % 7 + 6, seq % 7 + 8 from items)"""


@view("spans_greedy", "spans")
def _(d):
    """Greedy left-to-right choice over at most three spans of an item: a span is taken if it starts at or after the end of the last taken."""
    order = "partition by doc_id, seq order by s, s - e, kind"
    return f"""select doc_id, seq, kind, s, e, n = 1 or (n = 2 and s >= e1) or (n = 3 and s >= case when s2 >= e1 then e2 else e1 end) as accepted
      from (select *, row_number() over ({order}) as n, first_value(e) over ({order}) as e1, nth_value(s, 2) over ({order}) as s2, nth_value(e, 2) over ({order}) as e2 from spans)"""
