"""Ordered operators: neighbours, calibration, stacks, islands, samples."""

from __future__ import annotations

from folioforge.plans.catalog import operator, view

BEFORE = "partition by doc_id order by seq rows between unbounded preceding and 1 preceding"
AFTER = "partition by doc_id order by seq rows between 1 following and unbounded following"
UPTO = "partition by doc_id order by seq rows between unbounded preceding and current row"


@operator("win01_neighbour_headings", "items")
def _(d):
    """Nearest heading before and after each item."""
    x = "case when role = 'section_header' then seq end"
    return f"select doc_id, seq, {d.last(x, BEFORE)} as previous_heading, {d.first(x, AFTER)} as next_heading from items"


@operator("win02_previous_numbered_level", "calibrated")
def _(d):
    """Level of the numbered heading before in the same scope."""
    return "select doc_id, seq, regime_no, lag(calibrated_level) over (partition by doc_id, regime_no order by seq) as previous_level from calibrated"


@view("numbered", "headings", "parsed_numbers", "jn09_innermost_scope", "outline_matches")
def _(d):
    """Numbered headings with their scope: depth of the number, the scope's root level, and an absolute level for anchors (headings with one outline entry)."""
    return """select h.doc_id, h.seq, h.level, r.regime_no, cast(1 as bigint) as root_level, n.depth, case when o.outline_state = 'unique_exact' then o.outline_level end as anchor_level from headings h
      join parsed_numbers n on n.doc_id = h.doc_id and n.seq = h.seq and n.kind in ('decimal', 'article') join jn09_innermost_scope r on r.doc_id = h.doc_id and r.seq = h.seq left join outline_matches o on o.doc_id = h.doc_id and o.seq = h.seq"""


@view("calibrated", "numbered")
def _(d):
    """An anchor's own level; else the nearest earlier anchor's offset and the depth; else the depth below the scope's root."""
    before = "partition by doc_id, regime_no order by seq rows between unbounded preceding and 1 preceding"
    return f"select doc_id, seq, regime_no, root_level, level, depth, coalesce(anchor_level, depth + {d.last('anchor_level - depth', before)}, root_level + depth - 1) as calibrated_level from numbered"


@operator("win03_calibrated_level", "calibrated")
def _(d):
    """Calibrated levels of numbered headings."""
    return "select doc_id, seq, regime_no, calibrated_level from calibrated"


@view("heading_parents", "headings")
def _(d):
    """Parent of a heading: the latest earlier one of smaller level, one window per level."""
    per = ", ".join(f"{d.last(f'case when level = {k} then seq end', BEFORE)} as last_{k}" for k in range(1, 7))
    best = ", ".join(f"coalesce(case when {k} < level then last_{k} end, -1)" for k in range(1, 7))
    return f"select doc_id, seq, level, nullif(greatest({best}), -1) as parent_seq from (select doc_id, seq, level, {per} from headings)"


@operator("win04_hierarchy_parent", "heading_parents")
def _(d):
    """Parent of every heading; null for roots."""
    return "select doc_id, seq, level, parent_seq from heading_parents"


@view("scope_exits", "items", "scopes")
def _(d):
    """Ends of nested scopes at an item: before it, what stands open in the scope around is closed."""
    inner = d.row("b.s", "-b.e")
    return f"""select x.doc_id, x.around_s, x.around_e, x.s, x.e as boundary_seq from (select a.doc_id, a.s, a.e, max_by(b.s, {inner}) as around_s, max_by(b.e, {inner}) as around_e from scopes a
      join scopes b on b.doc_id = a.doc_id and b.s <= a.s and b.e >= a.e and (b.s < a.s or b.e > a.e) group by a.doc_id, a.s, a.e) x join items i on i.doc_id = x.doc_id and i.seq = x.e"""


@operator("win05_scope_exit_epochs", "scope_exits")
def _(d):
    """Items before which scopes around are cleared, with the number of scopes that end there and the epoch of the scope around that begins."""
    return "select doc_id, around_s, around_e, boundary_seq, n as ended, cast(row_number() over (partition by doc_id, around_s, around_e order by boundary_seq) as bigint) as epoch from (select doc_id, around_s, around_e, boundary_seq, count(*) as n from scope_exits group by doc_id, around_s, around_e, boundary_seq)"


@operator("win06_sparse_depth", "heading_parents")
def _(d):
    """Headings that skip levels below their parent, or as roots start deeper than one."""
    return "select h.doc_id, h.seq, h.parent_seq is null as at_root, h.level - coalesce(p.level, 0) - 1 as missing_levels from heading_parents h left join heading_parents p on p.doc_id = h.doc_id and p.seq = h.parent_seq where h.level - coalesce(p.level, 0) > 1"


@operator("win07_toc_order_conflict", "toc_targets", "toc_regions")
def _(d):
    """Contents rows whose target is not after all earlier ones of their region."""
    w = "partition by t.doc_id, r.start_seq order by t.seq rows between unbounded preceding and 1 preceding"
    return f"select t.doc_id, t.seq, t.target_seq, coalesce(t.target_seq <= max(t.target_seq) over ({w}), false) as conflict from toc_targets t left join toc_regions r on r.doc_id = t.doc_id and t.seq > r.start_seq and t.seq <= r.end_seq"


@view("toc_targets", "toc_matches", "toc_entries")
def _(d):
    """Contents rows with one target."""
    return "select m.doc_id, m.seq, min(m.target_seq) as target_seq, max(e.depth) as depth from toc_matches m join toc_entries e on e.doc_id = m.doc_id and e.seq = m.seq group by m.doc_id, m.seq having count(distinct m.target_seq) = 1"


# Least headings of a cluster and greatest spread of their left edges in points.
CLUSTER, SPREAD = 2, 1


@view("supported_levels", "items", "outline_matches", "toc_targets", "calibrated", "parsed_numbers")
def _(d):
    """Headings and items with the level that something supports, if any: one outline entry before a row of contents before a number."""
    return """select i.doc_id, i.seq, i.role, i.level, i.left_pt, n.kind, case when o.outline_state = 'unique_exact' then o.outline_level when e.depth is not null then e.depth else c.calibrated_level end as supported
      from items i left join outline_matches o on o.doc_id = i.doc_id and o.seq = i.seq left join (select doc_id, target_seq, min(depth) as depth from toc_targets group by doc_id, target_seq) e on e.doc_id = i.doc_id and e.target_seq = i.seq
        left join calibrated c on c.doc_id = i.doc_id and c.seq = i.seq left join parsed_numbers n on n.doc_id = i.doc_id and n.seq = i.seq"""


@view("level_transfers", "supported_levels")
def _(d):
    """Clusters of unnumbered headings between two supported items (or after the last) of which one has no level or skips one; their left edges agree. They take the later item's level if it is one
    below the earlier one's and all stand in line with it; else the level is in doubt (null). A heading that is supported itself and skips a level has its neighbours' clusters as its own."""
    w = "partition by doc_id order by seq rows between unbounded preceding and current row"
    return f"""select p.doc_id, p.before, p.after, cast(count(*) as bigint) as members, min(m.seq) as first_seq, max(m.seq) as last_seq,
        case when p.before_level = p.after_level - 1 and max(abs(m.left_pt - p.after_left)) <= {SPREAD} then p.after_level end as level
      from (select distinct h.doc_id, h.k, h.own, a.seq as before, a.supported as before_level, b.seq as after, b.supported as after_level, b.left_pt as after_left from heads h
          join anchors a on a.doc_id = h.doc_id and a.k = h.k - h.own left join anchors b on b.doc_id = h.doc_id and b.k = h.k + 1 where h.level is null or h.level not between 1 and 6 or h.level > a.supported + 1) p
      join heads m on m.doc_id = p.doc_id and (m.k = p.k and m.own <= p.own or p.own = 1 and m.k = p.k - 1 and m.own = 0)
      group by p.doc_id, p.before, p.before_level, p.after, p.after_level having count(*) >= {CLUSTER} and max(m.left_pt) - min(m.left_pt) <= {SPREAD}""".replace(
        "heads", f"(select doc_id, seq, level, left_pt, k, case when supported is null then 0 else 1 end as own from (select *, count(supported) over ({w}) as k from supported_levels) where role = 'section_header' and kind = 'none')"
    ).replace("anchors", f"(select * from (select *, count(supported) over ({w}) as k from supported_levels) where supported is not null)")


@operator("win08_local_level_transfer", "level_transfers")
def _(d):
    """Clusters of headings that take a level from their neighbours."""
    return "select doc_id, before, after, members, level from level_transfers"


@operator("win09_next_shallower", "headings")
def _(d):
    """Next heading of equal or smaller level: the nearest of one window for each level."""
    per = ", ".join(f"{d.first(f'case when level = {k} then seq end', AFTER)} as next_{k}" for k in range(1, 7))
    best = ", ".join(f"coalesce(case when {k} <= level then next_{k} end, 9223372036854775807)" for k in range(1, 7))
    return f"select doc_id, seq, nullif(least({best}), 9223372036854775807) as next_seq from (select doc_id, seq, level, {per} from headings)"


@operator("win10_prefix_marker_counts", "headings")
def _(d):
    """Headings so far, and those so far of the same level."""
    return "select doc_id, seq, cast(count(*) over (partition by doc_id order by seq) as bigint) as so_far, cast(count(*) over (partition by doc_id, level order by seq) as bigint) as same_so_far from headings"


@operator("win11_duplicate_ordinals", "lines")
def _(d):
    """Ordinal of a line among its equals in the document."""
    return "select doc_id, seq, cast(row_number() over (partition by doc_id, line order by seq) - 1 as bigint) as ordinal, cast(count(*) over (partition by doc_id, line) as bigint) as copies from lines"


@operator("win12_page_ranges", "items")
def _(d):
    """Contiguous ranges of selected pages."""
    return """select doc_id, min(page) as first_page, max(page) as last_page from (select doc_id, page, page - row_number() over (partition by doc_id order by page) as island
      from (select distinct doc_id, page from items where role = 'section_header')) group by doc_id, island"""


@view("anomalies", "items")
def _(d):
    """Anomalies of documents by category."""
    return "select cast(doc_id % 40 as bigint) as source_id, case when level = 4 then 'deep_heading' when line = '' then 'empty_text' else 'footer' end as category, doc_id * 4294967296 + seq as record_id from items where level = 4 or line = '' or role = 'page_footer'"


# Fixed value: records of a category in a sample.
SAMPLE = 25


@operator("win13_bounded_sample", "anomalies")
def _(d):
    """Sample of each category: the first of every source, then the next ones, as many as fit. Sources hold at most a sample each before categories are ranked."""
    return f"""select category, record_id, cast(n as bigint) as position from (select category, record_id, row_number() over (partition by category order by case when k = 1 then 0 else 1 end, source_id, record_id) as n
      from (select * from (select *, row_number() over (partition by category, source_id order by record_id) as k from anomalies) where k <= {SAMPLE})) where n <= {SAMPLE}"""


@operator("win14_ordinal_gaps", "kept_items")
def _(d):
    """Items whose ordinal is not their rank."""
    return "select doc_id, seq, ordinal, n as rank from (select doc_id, seq, ordinal, cast(row_number() over (partition by doc_id order by seq) - 1 as bigint) as n from kept_items) where n <> ordinal"


@operator("win15_doubling_ratios", "measurements")
def _(d):
    """Ratio of each measurement of a series to the one before."""
    w = "partition by series order by size_"
    return f"select series, size_, case when lag(cost) over ({w}) > 0 then round(cost / cast(lag(cost) over ({w}) as double), 6) end as ratio from measurements"


@operator("win16_first_appearance", "mentions")
def _(d):
    """Keys of a document in the order of first appearance."""
    return f"select doc_id, {d.listagg('lookup_key', 'at_, lookup_key')} as keys from (select doc_id, lookup_key, min(seq) as at_ from mentions group by doc_id, lookup_key) group by doc_id"


# Fixed value: points by which a list item is indented.
INDENT = 18


@operator("win17_first_indented_item", "items")
def _(d):
    """First list item after a heading that is indented against it, on its page and before the next heading of its level or above: one window for each level a heading may have."""
    heads = ", ".join(f"{d.first(f'case when level = {k} then seq end', AFTER)} as next_{k}" for k in range(1, 7))
    stop = "least(" + ", ".join(f"coalesce(case when {k} <= level then next_{k} end, 9223372036854775807)" for k in range(1, 7)) + ")"
    return f"""select h.doc_id, h.seq, min(i.seq) as item from (select doc_id, seq, page, left_pt, level, {stop} as stop from (select doc_id, seq, page, left_pt, level, {heads} from items) where level is not null) h
      left join items i on i.doc_id = h.doc_id and i.page = h.page and i.role = 'list_item' and i.seq > h.seq and i.seq < h.stop and i.left_pt - h.left_pt >= {INDENT} group by h.doc_id, h.seq"""
