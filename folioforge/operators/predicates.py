"""Filters and classification predicates."""

from __future__ import annotations

from folioforge.functions.scalars import CELL_COLUMNS, COORDINATE_KEY, DATA_SHARE, HEADER_ROWS, iou
from folioforge.plans.catalog import operator, view


# Fixed value: items in which references are looked for.
ELIGIBLE = "layer = 'body' and level is null and role in ('text', 'list_item', 'caption', 'footnote')"


@operator("flt01_mention_sources", "items")
def _(d):
    """Items in which references are looked for."""
    return f"select doc_id, seq from items where {ELIGIBLE}"


# Blocks that are not searched, in order; the first two must hold of the whole block.
EXCLUSIONS = {
    "page_furniture": r"(?i)^Page\s+[1-9][0-9]*\s+of\s+[1-9][0-9]*$",
    "standalone_target_label": r"^(?:(?:Table|Figure)\s+[1-9][0-9]*(?:[.-][A-Za-z0-9]+)*|APPENDIX\s+[A-Z])$",
    "bibliography": r"(?i)^[A-Z][A-Za-z&.'’ -]{1,80},\s*(?:19|20)[0-9]{2}[a-z]?\.",
    "deed_recordation": r"(?i)\brecorded\s+on\b[^\n]+\b(?:Book|Deeds|Official Records)\b[^\n]+\bpage\s+[1-9][0-9]*\b",
}
WHOLE = ("page_furniture", "standalone_target_label")


def exclusion(d) -> str:
    """The first reason why a block as a whole is not searched."""
    whens = " ".join(f"when {d.rlike('trim(mtext)' if k in WHOLE else 'mtext', p)} then '{k}'" for k, p in EXCLUSIONS.items())
    return f"case {whens} end"


@view("block_exclusions", "items")
def _(d):
    """Reason why a block as a whole is not searched; the first that holds."""
    return f"select doc_id, seq, {exclusion(d)} as reason from items"


@operator("flt02_block_exclusions", "block_exclusions")
def _(d):
    """Blocks excluded from the search, with the first reason."""
    return "select doc_id, seq, reason from block_exclusions where reason is not null"


# What follows a section reference that is not one to the document at hand.
STATUTORY = r"^\s+of\s+the\s+(?:[A-Z][\w'-]*\s+){0,5}(?:Act|Code)\b"
THIS_AGREEMENT = r"(?i)^\s+of\s+this\s+Agreement\b"
EXTERNAL_SECTION = r"(?i)^\s+of\s+(?:the\s+)?[^.;:\n]{0,80}(?:Agreement|UWMP|Plan|Report|Assessment|EIR)\b"
STATUTORY_DIGITS = 4


def disposition(d) -> str:
    """Whether a reference (its class, key and what follows) is local, statutory, to a section elsewhere, or page furniture."""
    by_number = f"case when length(regexp_extract(lookup_key, '^[0-9]+', 0)) >= {STATUTORY_DIGITS} then 'statutory' else 'local' end"
    return f"""case when mention_class = 'section' then case when {d.rlike('suffix', STATUTORY)} then 'statutory' when {d.rlike('suffix', THIS_AGREEMENT)} then {by_number} when {d.rlike('suffix', EXTERNAL_SECTION)} then 'qualified_external_section' else {by_number} end
      when mention_class = 'printed_page' and {d.rlike('suffix', PAGE_TOTAL)} then 'page_furniture' else 'local' end"""


@operator("flt04_section_dispositions", "references_found")
def _(d):
    """Statutory, local and external section references by what follows them."""
    return f"""select doc_id, seq, span_start, case when {d.rlike('suffix', STATUTORY)} then 'statutory' when {d.rlike('suffix', THIS_AGREEMENT)} then 'local'
      when {d.rlike('suffix', EXTERNAL_SECTION)} then 'qualified_external_section' else 'local' end as disposition from references_found where mention_class = 'section'"""


@operator("flt05_statutory_numbers", "references_found")
def _(d):
    """Section numbers whose first part has four digits or more."""
    return f"select doc_id, seq, span_start, lookup_key as number, length(regexp_extract(lookup_key, '^[0-9]+', 0)) >= {STATUTORY_DIGITS} as statutory from references_found where mention_class = 'section'"


PAGE_TOTAL = r"(?i)^\s+of\s+[1-9][0-9]*\b"
EXTERNAL_TABLE = r"(?i)^\s+(?:in|from|of)\s+reference\s+[1-9][0-9]*\b"
TABLE_LABEL = r"(?i)^table [1-9][0-9]*(?:[.-][a-z0-9]+)*$"


@operator("flt06_inline_page_furniture", "references_found")
def _(d):
    """Page references that are counters: followed by a total."""
    return f"select doc_id, seq, span_start, {d.rlike('suffix', PAGE_TOTAL)} as furniture from references_found where mention_class = 'printed_page'"


@operator("flt07_external_tables", "references_found")
def _(d):
    """Table references qualified by another document."""
    return f"select doc_id, seq, span_start, {d.rlike('suffix', EXTERNAL_TABLE)} as external from references_found where mention_class = 'table'"


@operator("flt08_table_labels", "items", "toc_regions")
def _(d):
    """Items that label a table: body, outside contents, one region, the label as a whole."""
    return f"""select i.doc_id, i.seq, lower(trim(i.mtext)) as lookup_key from items i where i.layer = 'body' and i.n_regions = 1 and {d.rlike('trim(i.mtext)', TABLE_LABEL)}
      and not exists (select 1 from toc_regions r where r.doc_id = i.doc_id and i.seq between r.start_seq and r.end_seq)"""


@operator("flt09_deferred_mentions", "local_resolution")
def _(d):
    """References left for other documents."""
    return "select doc_id, seq, span_start, lookup_key from local_resolution where status = 'unresolved' and reason = 'deferred_cross_document'"


@view("page_features", "items")
def _(d):
    """Measured features of pages."""
    digits = f"length({d.replace_all('line', '[^0-9]', '')})"
    return f"""select doc_id, page, cast(sum(length(line)) as bigint) as chars, cast(sum(length(replace(line, ' ', ''))) as bigint) as nonspace, cast(sum({digits}) as bigint) as digits,
      cast(sum(case when line <> '' then 1 else 0 end) as bigint) as nonempty_lines, cast(sum(case when level is not null then 1 else 0 end) as bigint) as regions,
      max(length(line)) / cast(600 as double) as width_fraction, count(*) / cast(8 as double) as height_fraction from items group by doc_id, page"""


# Thresholds of the page routes.
STRICT = {"width_fraction": 0.7, "height_fraction": 0.75, "nonempty_lines": 80, "density": 0.02, "digit_fraction": 0.35}
NUMERIC = {"width_fraction": 0.7, "nonempty_lines": 20, "density": 0.005, "digit_fraction": 0.5}
PARTIAL_HEIGHT = 0.35


@operator("flt10_page_route", "page_measures")
def _(d):
    """Route of a page: whole if all strict or all numeric checks hold, or all strict ones but the height, which is partial; then pages with layout regions; else none."""
    def all_of(checks: dict) -> str:
        return " and ".join(f"{k} >= {v}" for k, v in checks.items())

    partial = all_of(STRICT | {"height_fraction": PARTIAL_HEIGHT})
    return f"""select doc_id, page, case when ({all_of(STRICT)}) or ({all_of(NUMERIC)}) or (height_fraction < {STRICT['height_fraction']} and {partial}) then 'full_page_numeric'
      when regions > 0 then 'layout_regions' else 'no_table_route' end as route from page_measures"""


@operator("flt11_layout_regions", "layout_regions")
def _(d):
    """Regions of each known page in visual order."""
    return "select page, box_id, part_no, l, b, r, t, cast(row_number() over (partition by page order by t desc, l, b desc, r, box_id, part_no) as bigint) as position from layout_regions where page_known"


@operator("flt12_boundary_markers", "page_marks")
def _(d):
    """Captions and headers whose bottom is not below the highest table top of their page, from the top down."""
    return """select m.page, m.box_id, m.part_no, cast(row_number() over (partition by m.page order by m.t desc, m.box_id, m.part_no) as bigint) as position from page_marks m
      join (select page, max(t) as top from page_marks where role = 'table' group by page) h on m.page = h.page where m.role in ('caption', 'section_header') and m.b >= h.top"""


# Least size in pixels and crossings of a ruled region.
RULED = {"width": 60, "height": 18, "intersections": 4}


@operator("flt13_ruled_regions", "ruled_regions")
def _(d):
    """Regions large enough and with crossings enough to hold a ruled table."""
    return f"select box_id, part_no, width, height from ruled_regions where {' and '.join(f'{k} >= {v}' for k, v in RULED.items())}"


# Fixed value: greatest share of a candidate that ruled boxes may cover.
MAX_RULING_COVERAGE = 0.1

CANDIDATE = "box_id, part_no, cl, cb, cr, ct"


@view("ruling_overlaps", "network_boxes", "ruled_boxes")
def _(d):
    """What each ruled box covers of a candidate (its own edges as cl, cb, cr, ct)."""
    return """select x.box_id, x.part_no, x.l as cl, x.b as cb, x.r as cr, x.t as ct, greatest(x.l, y.l) as l, greatest(x.b, y.b) as b, least(x.r, y.r) as r, least(x.t, y.t) as t
      from network_boxes x join ruled_boxes y on y.box_id = x.box_id where x.l < y.r and y.l < x.r and x.b < y.t and y.b < x.t"""


@view("ruling_strips", "ruling_overlaps")
def _(d):
    """Upright strips of a candidate between neighbouring edges of its overlaps."""
    return f"""select {CANDIDATE}, e as x1, lead(e) over (partition by {CANDIDATE} order by e) as x2
      from (select {CANDIDATE}, l as e from ruling_overlaps union select {CANDIDATE}, r as e from ruling_overlaps)"""


@view("ruling_lengths", "ruling_overlaps", "ruling_strips")
def _(d):
    """What each overlap adds, from below, to the covered height of a strip."""
    same = " and ".join(f"s.{c} = o.{c}" for c in CANDIDATE.split(", "))
    key = ", ".join(f"o.{c}" for c in CANDIDATE.split(", "))
    below = f"max(o.t) over (partition by {key}, s.x1 order by o.b, o.t rows between unbounded preceding and 1 preceding)"
    return f"select {key}, s.x2 - s.x1 as width, greatest(cast(0 as double), o.t - greatest(o.b, coalesce({below}, o.b))) as height from ruling_strips s join ruling_overlaps o on {same} and o.l <= s.x1 and o.r >= s.x2"


@operator("flt14_network_candidates", "network_boxes", "ruling_lengths")
def _(d):
    """Share of each candidate that all ruled boxes of its record cover together, and whether it is small enough to keep the candidate."""
    return f"""select box_id, part_no, coverage, coverage <= {MAX_RULING_COVERAGE} as kept from (select x.box_id, x.part_no, round(coalesce(c.area / nullif((x.r - x.l) * (x.t - x.b), 0), cast(0 as double)), 9) as coverage from network_boxes x
      left join (select {CANDIDATE}, sum(width * height) as area from ruling_lengths group by {CANDIDATE}) c on c.box_id = x.box_id and c.part_no = x.part_no and c.cl = x.l and c.cb = x.b and c.cr = x.r and c.ct = x.t)"""


@view("accepted_regions", "boxes")
def _(d):
    """Regions that a parser matched."""
    return "select distinct box_id, part_no from boxes where (box_id + part_no) % 3 = 0"


@operator("flt15_unmatched_regions", "boxes", "accepted_regions")
def _(d):
    """Regions without a match."""
    return "select b.box_id, b.part_no, count(*) as n from boxes b where not exists (select 1 from accepted_regions a where a.box_id = b.box_id and a.part_no = b.part_no) group by b.box_id, b.part_no"


@view("learned_attempts", "grid")
def _(d):
    """Measured outcomes of learned table structure."""
    return """select table_id, case when min(l_partkey) % 17 = 0 then cast(0 as bigint) else cast(count(*) as bigint) end as tokens, count(*) % 5 <> 0 as valid_structure, min(l_partkey) % 7 <> 0 as grid_covers, cast(max(l_quantity) as double) / 12 as overshoot,
      min(l_partkey) % 11 = 0 as leading_unmatched, cast(sum(case when l_partkey % 9 = 0 then 1 else 0 end) as bigint) as duplicates, cast(sum(l_quantity) as double) / 60 as coverage, min(l_partkey) % 4 <> 0 as monotonic, cast(sum(case when l_partkey % 5 <> 0 then 1 else 0 end) as bigint) as filled from grid group by table_id"""


# Bounds of a learned table.
MAX_OVERSHOOT, MIN_TEXT_COVERAGE = 3, 0.9
LEARNED_OUTCOMES = ("accepted", "no_tokens", "structure", "grid_coverage", "overshoot", "unmatched_leading_text", "duplicates", "text_coverage", "grid_order", "empty")


@view("learned_gates", "learned_attempts")
def _(d):
    """First gate that a learned table fails."""
    return f"""select table_id, case when tokens = 0 then 'no_tokens' when not valid_structure then 'structure' when not grid_covers then 'grid_coverage' when overshoot > {MAX_OVERSHOOT} then 'overshoot' when leading_unmatched then 'unmatched_leading_text'
      when duplicates > 0 then 'duplicates' when coverage < {MIN_TEXT_COVERAGE} then 'text_coverage' when not monotonic then 'grid_order' when filled = 0 then 'empty' else 'accepted' end as outcome from learned_attempts"""


@operator("flt16_learned_acceptance", "learned_gates")
def _(d):
    """Outcome of the ordered acceptance gates."""
    return "select table_id, outcome from learned_gates"


# Longest text of a structural sibling, and how far its left edge may be from its neighbours' in points.
SIBLING_CHARS, SIBLING_POINTS = 160, 1


@operator("flt17_sibling_pattern", "items", "parsed_numbers", "jn03_alignment_lookup", "toc_regions")
def _(d):
    """Short unnumbered texts outside contents, aligned on their page and in line with the headings before and after, which are of one level and on the same page, while the items next to them are body texts (structural siblings)."""
    near = "partition by doc_id order by seq"
    before, after = f"{near} rows between unbounded preceding and 1 preceding", f"{near} rows between 1 following and unbounded following"
    heading = "case when role = 'section_header' then {} end"
    around = ", ".join(f"{f(heading.format(c), w)} as {c}_{n}" for n, f, w in (("before", d.last, before), ("after", d.first, after)) for c in ("page", "level", "left_pt"))
    text = "lag({0}) over ({1}) = {2} and lead({0}) over ({1}) = {2}"
    plain = f"{text.format('layer', near, chr(39) + 'body' + chr(39))} and {text.format('role', near, chr(39) + 'text' + chr(39))} and trim(lag(line) over ({near})) <> '' and trim(lead(line) over ({near})) <> ''"
    return f"""select x.doc_id, x.seq, coalesce(x.role = 'text' and x.page_before = x.page and x.page_after = x.page and x.level_before = x.level_after and abs(x.left_pt_before - x.left_pt) <= {SIBLING_POINTS} and abs(x.left_pt_after - x.left_pt) <= {SIBLING_POINTS}
        and x.plain and length(x.line) <= {SIBLING_CHARS} and n.kind = 'none' and a.layout_state = 'unique_aligned' and not exists (select 1 from toc_regions r where r.doc_id = x.doc_id and x.seq between r.start_seq and r.end_seq), false) as sibling
      from (select doc_id, seq, page, role, line, left_pt, {around}, {plain} as plain from items) x left join parsed_numbers n on n.doc_id = x.doc_id and n.seq = x.seq left join jn03_alignment_lookup a on a.doc_id = x.doc_id and a.seq = x.seq"""


@view("footers", "tables")
def _(d):
    """Footer counters of table pages."""
    return "select page, cast(floor(page / 40) as bigint) as sheet, cast(page % 40 as bigint) as internal_page, cast(40 as bigint) as total from tables group by page"


@operator("flt18_footer_continuation", "footers")
def _(d):
    """Pages whose footer continues the one before: same sheet and total, both counters one more."""
    return "select b.page from footers a join footers b on b.page = a.page + 1 where a.sheet = b.sheet and a.total = b.total and b.internal_page = a.internal_page + 1"


@view("headers", "cells", "header_rows")
def _(d):
    """All columns of each table's header rows, and the table's number of columns; tables whose header has no text have none."""
    if d.name == "spark":  # the few header rows of a table as a list: cells then stay where their table is
        header = "coalesce(array_contains(h.header_rows, x.r), false)"
        return f"""select x.table_id, {d.listagg(f"case when {header} then cast(x.r as string) || ':' || x.text end", 'x.r, x.c', '|')} as header, cast(max(x.c) + 1 as bigint) as columns from cells x
      left join (select table_id, collect_list(r) as header_rows from header_rows group by table_id) h on h.table_id = x.table_id group by x.table_id having sum(case when {header} and x.text <> '' then 1 else 0 end) > 0"""
    return f"""select x.table_id, {d.listagg("case when h.table_id is not null then cast(x.r as string) || ':' || x.text end", 'x.r, x.c', '|')} as header, cast(max(x.c) + 1 as bigint) as columns from cells x
      left join header_rows h on h.table_id = x.table_id and h.r = x.r group by x.table_id having sum(case when h.table_id is not null and x.text <> '' then 1 else 0 end) > 0"""


@view("headers_in_rows", "row_texts_in_rows")
def _(d):
    """``headers`` where a row's cells are in one row: header rows are marked on the way, so nothing is joined."""
    w = "partition by table_id order by r rows between unbounded preceding and current row"
    data = f"case when {d.rlike('text', COORDINATE_KEY)} or filled > 0 and numbers >= {DATA_SHARE} * filled then 1 else 0 end"
    marked = f"select table_id, r, texts, filled, max({data}) over ({w}) = 0 and row_number() over (partition by table_id order by r) <= {HEADER_ROWS} as header from row_texts_in_rows where table_id is not null"
    return f"""select table_id, array_join(flatten(transform(array_sort(collect_list(struct(r, texts)) filter (where header)), x -> transform(x.texts, t -> cast(x.r as string) || ':' || t))), '|') as header, cast(max(size(texts)) as bigint) as columns
      from ({marked}) group by table_id having sum(case when header then filled else 0 end) > 0"""


@operator("flt19_header_equality", "headers")
def _(d):
    """Tables whose header equals that of the table before."""
    return "select a.table_id as first_id, b.table_id as next_id from headers a join headers b on b.table_id = a.table_id + 1 and a.header = b.header and a.columns = b.columns"


# Bounds of a continuation's geometry.
EDGES = {"left_bottom": 0.20, "right_top": 0.80, "span": 0.03, "columns": 0.02}


@operator("flt20_edge_geometry", "table_edges")
def _(d):
    """Tables that end low on a page and go on at the top of the next, with both edges of the span and all column boundaries in place."""
    columns = d.max_delta("x.boundaries", "y.boundaries")
    return f"""select x.box_id, x.part_no, coalesce(x.bottom_fraction <= {EDGES['left_bottom']} and y.top_fraction >= {EDGES['right_top']} and greatest(abs(x.left_fraction - y.left_fraction), abs(x.right_fraction - y.right_fraction)) <= {EDGES['span']}
      and {columns} <= {EDGES['columns']}, false) as compatible from table_edges x join table_edges y on y.box_id = x.box_id and y.part_no = x.part_no + 1"""


@view("column_types", "cells")
def _(d):
    """Dominant kind of each column, ties by text, numeric, missing, empty."""
    numeric = d.rlike("text", "^[0-9]+$")
    return f"""select table_id, c, max_by(kind, n * 10 - rank_) as dominant from (select table_id, c, kind, count(*) as n, max(case kind when 'text' then 0 when 'numeric' then 1 when 'missing' then 2 else 3 end) as rank_
      from (select table_id, c, case when text = '' then 'empty' when text = '-' then 'missing' when {numeric} then 'numeric' else 'text' end as kind from cells) group by table_id, c, kind) group by table_id, c"""


KINDS = ("text", "numeric", "missing", "empty")  # fixed values: kinds of columns, the first of those with most cells wins


@view("column_types_in_rows", "cell_rows")
def _(d):
    """``column_types`` where a row's cells are in one row: kinds are counted table by table."""
    kinds = ", ".join(f"case when texts[{c}] = '' then 'empty' when texts[{c}] = '-' then 'missing' when {d.rlike(f'texts[{c}]', '^[0-9]+$')} then 'numeric' else 'text' end as k{c}" for c in range(CELL_COLUMNS))
    score = "count_if(k{0} = '{1}') * 10 - {2}"
    best = ", ".join("array_max(array(" + ", ".join(f"struct({score.format(c, k, i)} as score, '{k}' as kind)" for i, k in enumerate(KINDS)) + ")).kind" for c in range(CELL_COLUMNS))
    return f"select table_id, cast(c as int) as c, dominant from (select table_id, array({best}) as found from (select table_id, {kinds} from cell_rows) group by table_id) lateral view posexplode(found) x as c, dominant"


@operator("flt21_type_compatibility", "column_types")
def _(d):
    """Neighbouring tables whose columns have the same kinds, numbers and missing values mixing freely."""
    return """select a.table_id as first_id, b.table_id as next_id, min(case when a.dominant = b.dominant or (a.dominant in ('numeric', 'missing') and b.dominant in ('numeric', 'missing')) then 1 else 0 end) = 1 as compatible
      from column_types a join column_types b on b.table_id = a.table_id + 1 and a.c = b.c group by a.table_id, b.table_id"""


TOC_START = r"^table of contents( [(]continued[)])?$"


@view("toc_starts", "toc_titles")
def _(d):
    """Headings of the body that open a table of contents."""
    return f"select doc_id, seq, page from toc_titles where role = 'section_header' and layer = 'body' and {d.rlike('lower(trim(title))', TOC_START)}"


@operator("flt22_toc_start", "toc_starts")
def _(d):
    """Starts of tables of contents."""
    return "select doc_id, seq, page from toc_starts"


# Errors after which an attempt is not tried again.
TERMINAL_ERRORS = ("FileNotFoundError", "PermissionError", "ValidationError", "HierarchyAuthorizationError", "SourceIdentityError")


@operator("flt23_failure_classes", "failures")
def _(d):
    """State after a failure: timeouts cancel, terminal kinds end, others may be tried again."""
    kinds = ", ".join(f"'{x}'" for x in TERMINAL_ERRORS)
    return f"select event_id, case when error_type = 'TimeoutError' then 'cancelled' when error_type in ({kinds}) then 'failed_terminal' else 'failed_retryable' end as state from failures"


FAMILY_QUALIFIER = r"\b(?:Draft|Final) EIR\b"


@operator("flt24_family_qualifier", "references_found")
def _(d):
    """Family qualifier within 64 characters before or after a reference."""
    return f"select doc_id, seq, span_start, mention_class, {d.rlike('prefix', FAMILY_QUALIFIER)} or {d.rlike('substr(suffix, 1, 64)', FAMILY_QUALIFIER)} as qualified from references_found"


@operator("flt25_unparsed_index_text", "items", "toc_regions")
def _(d):
    """List items outside every region of contents and not headings."""
    return "select i.doc_id, i.seq from items i where i.role = 'list_item' and not exists (select 1 from toc_regions r where r.doc_id = i.doc_id and i.seq between r.start_seq and r.end_seq)"


@operator("flt26_learned_fallback", "boxes", "accepted_regions", "learned_gates")
def _(d):
    """Fallback outcome for unmatched regions."""
    return """select b.box_id, b.part_no, a.box_id is not null or coalesce(g.outcome = 'accepted', false) as matched, a.box_id is not null as ruled_match, case when a.box_id is not null then 'not_needed' else coalesce(g.outcome, 'not_attempted') end as status
      from (select distinct box_id, part_no from boxes) b left join accepted_regions a on a.box_id = b.box_id and a.part_no = b.part_no left join learned_gates g on g.table_id = b.box_id"""


@operator("flt27_model_corpus_source", "sources")
def _(d):
    """Sources of the model corpus, each with exactly one match."""
    return "select source_id, max(pages) as pages from sources where role = 'model_corpus' group by source_id having count(*) = 1"


@operator("jn16_overlap_candidates", "boxes")
def _(d):
    """Pairs of boxes of a record that overlap enough to be matched."""
    return f"select x.box_id, x.part_no as region_no, y.part_no as table_no, round({iou('x', 'y')}, 6) as iou from boxes x join boxes y on x.box_id = y.box_id and x.part_no < y.part_no where {iou('x', 'y')} >= 0.5"
