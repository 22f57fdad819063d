"""Aggregations."""

from __future__ import annotations

from folioforge.operators.predicates import LEARNED_OUTCOMES
from folioforge.plans.catalog import operator, view


@operator("agg01_source_counts", "sources", "roles")
def _(d):
    """Sources, bytes and pages of every role, zeros included, and in total."""
    return """select r.role, count(s.source_id) as sources, cast(coalesce(sum(s.bytes), 0) as bigint) as bytes, cast(coalesce(sum(s.pages), 0) as bigint) as pages from roles r left join sources s on s.role = r.role group by r.role
      union all select 'total', count(*), cast(sum(bytes) as bigint), cast(sum(pages) as bigint) from sources"""


@operator("agg02_terminal_states", "candidates")
def _(d):
    """Outcomes of a collection."""
    return "select count(*) as total, count(*) filter (where terminal_state = 'complete') as complete, count(*) filter (where terminal_state = 'complete_with_warnings') as complete_with_warnings, count(*) filter (where terminal_state = 'failed_terminal') as failed_terminal from candidates"


@operator("agg03_link_status", "collection_resolution")
def _(d):
    """Statuses of collection links."""
    return "select status, count(*) as n from collection_resolution group by status"


@operator("agg04_mention_counts", "local_resolution")
def _(d):
    """References by class, status and reason in long form."""
    return """select 'class' as kind, mention_class as key, count(*) as n from local_resolution group by mention_class union all select 'status', status, count(*) from local_resolution group by status
      union all select 'reason', reason, count(*) from local_resolution where reason is not null group by reason"""


@view("rule_numbers")
def _(d):
    """Rules of the cascade."""
    return "select * from (values ('R01'), ('R02'), ('R03'), ('R04'), ('R05'), ('R06'), ('R07'), ('R08')) v(rule)"


@operator("agg05_rule_summary", "rule_numbers", "decisions")
def _(d):
    """Selected and merely eligible decisions of every rule."""
    if d.name == "spark":  # decisions are counted by their few lists of rules first: a join by anything but equality sends its other side to the driver whole
        return """select r.rule, coalesce(sum(x.n) filter (where x.selected = r.rule), 0) as selected, coalesce(sum(x.n) filter (where instr(x.eligible, r.rule) > 0 and x.selected <> r.rule), 0) as eligible_only
          from rule_numbers r left join (select eligible, selected, count(*) as n from decisions group by eligible, selected) x on instr(x.eligible, r.rule) > 0 group by r.rule"""
    return """select r.rule, count(*) filter (where x.selected = r.rule) as selected, count(*) filter (where instr(x.eligible, r.rule) > 0 and x.selected <> r.rule) as eligible_only
      from rule_numbers r left join decisions x on instr(x.eligible, r.rule) > 0 group by r.rule"""


@view("document_metrics", "items", "mentions", "headings")
def _(d):
    """Row counts of a document by record family."""
    return """select doc_id, 'items' as metric, count(*) as value from items group by doc_id union all select doc_id, 'mentions', count(*) from mentions group by doc_id
      union all select doc_id, 'headings', count(*) from headings group by doc_id"""


@operator("agg06_document_metrics", "document_metrics")
def _(d):
    """Rows of each family of a document."""
    return "select doc_id, metric, value from document_metrics"


@operator("agg07_collection_totals", "documents")
def _(d):
    """Sums of seconds and bytes, and the largest memory, by source."""
    return "select source, cast(sum(n_chars) as bigint) as output_bytes, round(sum(n_chars / cast(1000 as double)), 3) as wall_seconds, max(n_chars * 3) as peak_rss from documents group by source"


@operator("agg08_metric_extrema", "document_metrics")
def _(d):
    """Least and greatest document of every metric, ties by id; combined before they are shuffled."""
    lo, hi = d.row("value", "doc_id"), d.row("value", "doc_id")
    return f"select metric, min_by(doc_id, {lo}) as min_doc, min(value) as min_value, max_by(doc_id, {hi}) as max_doc, max(value) as max_value from document_metrics group by metric"


@operator("agg09_anomaly_counts", "anomalies")
def _(d):
    """Anomalies and their samples by category."""
    return "select category, count(*) as candidates, least(count(*), 25) as sampled from anomalies group by category"


@operator("agg10_column_signature", "cells")
def _(d):
    """Counts and fractions of the kinds of a table's columns."""
    numeric = d.rlike("text", "^[0-9]+$")
    return f"""select table_id, cast(c as bigint) as c, kind, count(*) as n, round(count(*) / cast(max(total) as double), 6) as fraction from (select table_id, c, count(*) over (partition by table_id, c) as total,
      case when text = '' then 'empty' when text = '-' then 'missing' when {numeric} then 'numeric' else 'text' end as kind from cells) group by table_id, c, kind"""


@operator("agg11_character_coverage", "grid")
def _(d):
    """Characters of the cells that the native text covers as a multiset, and characters beyond it."""
    chars = [f"select table_id, substr(x, cast(k as int), 1) as ch, count(*) as n from {d.series(f'(select table_id, {x} as x, length({x}) as len from grid)', 'k', '1', 'len')} group by table_id, substr(x, cast(k as int), 1)" for x in ("cast(l_partkey as string)", "cast(l_partkey + 7 as string)")]
    return f"select coalesce(a.table_id, b.table_id) as table_id, cast(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) as bigint) as covered, cast(sum(greatest(0, coalesce(b.n, 0) - coalesce(a.n, 0))) as bigint) as duplicates from ({chars[0]}) a full outer join ({chars[1]}) b on a.table_id = b.table_id and a.ch = b.ch group by coalesce(a.table_id, b.table_id)"


@operator("agg12_grid_boundaries", "boxes")
def _(d):
    """Median edges by index, and whether they rise."""
    return "select part_no, edge, coalesce(edge >= lag(edge) over (order by part_no), true) as rises from (select part_no, median(l) as edge from boxes group by part_no)"


@operator("agg13_text_coverage", "boxes")
def _(d):
    """Extents of text on a page as shares of its size."""
    return "select page, round((max(r) - min(l)) / 612, 6) as width_fraction, round((max(t) - min(b)) / 792, 6) as height_fraction from boxes where page_known group by page"


@operator("agg14_page_text_features", "page_features")
def _(d):
    """Digit share, density and line count of pages."""
    return "select doc_id, page, round(digits / cast(greatest(nonspace, 1) as double), 6) as digit_fraction, round(nonspace / cast(484704 as double), 9) as density, nonempty_lines from page_features"


@operator("agg15_union_box", "boxes")
def _(d):
    """Box around all parts of a record."""
    return "select box_id, min(l) as l, max(t) as t, max(r) as r, min(b) as b from boxes group by box_id"


@operator("agg16_footer_consensus", "items")
def _(d):
    """Printed label of a page: the counters if they agree, else the stand-alone labels if they do."""
    return """select doc_id, page, case when count(distinct primary_) = 1 then max(primary_) when count(distinct primary_) = 0 and count(distinct standalone) = 1 then max(standalone) end as label
      from (select doc_id, page, case when seq % 3 = 0 then cast(page + (seq % 4) * (doc_id % 2) as string) end as primary_, case when seq % 3 = 1 then cast(page as string) end as standalone from items) group by doc_id, page"""


@view("page_label_evidence", "items")
def _(d):
    """State of explicit and visible labels of pages."""
    state = "case count(distinct {x}) when 0 then 'absent' when 1 then 'present' else 'conflict' end as {n}"
    return f"select doc_id, page, {state.format(x='explicit', n='explicit_state')}, {state.format(x='visible', n='visible_state')} from (select doc_id, page, case when doc_id % 3 = 0 and seq % 2 = 0 then page + (case when page = 3 then seq % 4 else 0 end) end as explicit, case when doc_id % 2 = 0 and role = 'page_footer' then page end as visible from items) group by doc_id, page"


@operator("agg17_page_label_evidence", "page_label_evidence")
def _(d):
    """Absent, present or conflicting label evidence."""
    return "select doc_id, page, explicit_state, visible_state from page_label_evidence"


@view("aliases", "target_index")
def _(d):
    """Aliases by kind and normalised spelling with their targets."""
    return "select doc_id, target_type as alias_kind, lookup_key as normalized_alias, count(distinct target_id) as targets, min(target_id) as first_target from target_index group by doc_id, target_type, lookup_key"


@operator("agg18_alias_groups", "aliases")
def _(d):
    """Unique and ambiguous aliases."""
    return "select doc_id, alias_kind, normalized_alias, targets, case when targets = 1 then 'unique' else 'ambiguous' end as status from aliases"


@view("mention_status", "mentions", "mention_candidates")
def _(d):
    """Number of targets of each reference."""
    return "select m.doc_id, m.seq, m.span_start, m.mention_class, m.lookup_key, m.page, count(distinct c.target_id) as candidates from mentions m left join mention_candidates c on c.doc_id = m.doc_id and c.seq = m.seq and c.span_start = m.span_start group by m.doc_id, m.seq, m.span_start, m.mention_class, m.lookup_key, m.page"


@operator("agg19_candidate_status", "mention_status")
def _(d):
    """Resolution by the number of targets."""
    return "select doc_id, seq, span_start, mention_class, candidates, case candidates when 0 then 'unresolved' when 1 then 'resolved' else 'ambiguous' end as status from mention_status"


@operator("agg20_outline_depth", "outline")
def _(d):
    """Depth of outline titles that have one depth only."""
    return "select doc_id, normalized_title, min(depth) as depth from outline group by doc_id, normalized_title having count(distinct depth) = 1"


@operator("agg21_route_counts", "flt10_page_route")
def _(d):
    """Pages by route."""
    return "select route, count(*) as pages from flt10_page_route group by route"


@operator("agg22_table_run_summary", "learned_gates")
def _(d):
    """Tables by outcome, the closed set zero-filled."""
    outcomes = ", ".join(f"('{x}')" for x in LEARNED_OUTCOMES)
    return f"""select v.outcome, count(g.table_id) as tables from (select * from (values {outcomes}) v(outcome)) v
      left join learned_gates g on g.outcome = v.outcome group by v.outcome"""


@operator("agg23_warning_scopes", "anomalies")
def _(d):
    """Warnings by scope: raw, distinct by source, and together."""
    return "select category, count(*) as raw, count(distinct source_id) as sources, count(*) + count(distinct source_id) as aggregate from anomalies group by category"


@operator("agg26_payload_groups", "documents")
def _(d):
    """Payloads by role and digest: copies and bytes beyond one of them."""
    return f"select source, sha, count(*) as paths, cast(sum(n_chars) - max(n_chars) as bigint) as duplicate_bytes, count(distinct n_chars) = 1 as consistent from (select source, {d.sha256('text')} as sha, n_chars from documents) group by source, sha"


@operator("agg27_directory_bytes", "documents")
def _(d):
    """Bytes by folder."""
    return "select source, cast(sum(n_chars) as bigint) as bytes from documents group by source"


@operator("agg28_retained_titles", "toc_regions", "items")
def _(d):
    """Distinct titles of a region of contents."""
    return "select r.doc_id, r.start_seq, count(distinct lower(trim(i.line))) as titles from toc_regions r join items i on i.doc_id = r.doc_id and i.seq > r.start_seq and i.seq <= r.end_seq where trim(i.line) <> '' group by r.doc_id, r.start_seq"


@operator("agg29_release_scope", "sources")
def _(d):
    """Sources, pages and warnings kept for a release."""
    return "select count(*) as sources, cast(sum(pages) as bigint) as pages, count(*) filter (where pages > 250) as warnings from sources where role = 'model_corpus'"


@operator("agg30_semantic_counts", "heading_parents", "items")
def _(d):
    """Exact counts of a hierarchy: features, headings, edges, roots."""
    return "select 'features' as kind, count(*) as n from items union all select 'headings', count(*) from heading_parents union all select 'edges', count(*) from heading_parents where parent_seq is not null union all select 'roots', count(*) from heading_parents where parent_seq is null"
