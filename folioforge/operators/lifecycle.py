"""Attempts, resolution, hand-off, projections of records, and reports."""

from __future__ import annotations

from folioforge.operators.joins import TABLE_PAGE_WINDOW
from folioforge.operators.predicates import EXTERNAL_TABLE
from folioforge.plans.catalog import operator, view

# Transitions of an attempt, and the producer's statuses that a state may come with ("" is none).
LEGAL = (
    ("none", "selected"), ("selected", "running"), ("running", "complete"), ("running", "complete_with_warnings"),
    ("running", "failed_retryable"), ("running", "failed_terminal"), ("running", "cancelled"),
)
STATUSES = {
    "selected": ("PENDING",), "running": ("STARTED",), "complete": ("SUCCESS",), "complete_with_warnings": ("SUCCESS",),
    "failed_retryable": ("SUCCESS", "PARTIAL_SUCCESS", "FAILURE", "SKIPPED", ""), "failed_terminal": ("SUCCESS", "PARTIAL_SUCCESS", "FAILURE", "SKIPPED", ""), "cancelled": ("PARTIAL_SUCCESS", ""),
}
MAX_ATTEMPTS = 5


@view("transitions", "attempts")
def _(d):
    """Each state with the one before it."""
    return "select transaction_id, sequence, state, raw_status, coalesce(lag(state) over (partition by transaction_id order by sequence), 'none') as before from attempts"


@operator("lif01_illegal_transitions", "transitions")
def _(d):
    """Events that do not follow legally on the one before, or whose raw status their state may not have."""
    legal = " or ".join(f"(before = '{a}' and state = '{b}')" for a, b in LEGAL)
    fits = " or ".join(f"(state = '{k}' and coalesce(raw_status, '') in ({', '.join(repr(x) for x in v)}))" for k, v in STATUSES.items())
    return f"""select transaction_id, sequence, before, state, raw_status, 'transition' as violation from transitions where not ({legal})
      union all select transaction_id, sequence, before, state, raw_status, 'status' from transitions where not ({fits})"""


@operator("lif02_history_gaps", "histories")
def _(d):
    """Histories that are not contiguous from 1 or name more than one source."""
    return """select transaction_id, count(*) as events, max(sequence) as last_sequence, count(distinct source_id) as sources from histories group by transaction_id
      having count(*) <> max(sequence) or min(sequence) <> 1 or count(distinct sequence) <> count(*) or count(distinct source_id) <> 1"""


@operator("lif03_next_attempt", "attempts")
def _(d):
    """Number of the next attempt, or why there is none; a dangling run is closed as cancelled first."""
    return f"""select transaction_id, attempts + 1 as next_attempt, case when last_sequence <> events then 'refuse_gap' when last_state in ('complete', 'complete_with_warnings') then 'refuse_complete' when last_state = 'failed_terminal' then 'refuse_terminal'
      when attempts >= {MAX_ATTEMPTS} then 'refuse_limit' when last_state in ('selected', 'running') then 'close_then_retry' else 'retry' end as verdict
      from (select transaction_id, count(*) filter (where state = 'selected') as attempts, count(*) as events, max(sequence) as last_sequence, max_by(state, sequence) as last_state from attempts group by transaction_id)"""


@operator("lif04_reusable_candidate", "sources", "verified_candidates")
def _(d):
    """Sources with their reusable candidate, none, or too many of them."""
    return """select s.source_id, case when count(c.candidate_id) = 1 then min(c.candidate_id) end as candidate_id, case when count(c.candidate_id) > 1 then 'ambiguous' when count(c.candidate_id) = 1 then 'reuse' else 'none' end as verdict
      from sources s left join verified_candidates c on c.of_source = s.source_id group by s.source_id"""


@operator("lif05_unrecorded_candidates", "candidates", "attempts")
def _(d):
    """Candidates without a terminal event."""
    return "select c.source_id, c.candidate_id from candidates c where not exists (select 1 from attempts a where a.transaction_id = c.source_id and a.state in ('complete', 'complete_with_warnings'))"


@view("accounting", "candidates")
def _(d):
    """Terminal outcome of every source."""
    return "select source_id, source_ordinal, terminal_state, case when terminal_state <> 'failed_terminal' then candidate_id end as candidate_id, failure_class from candidates"


@operator("lif06_terminal_outcome", "accounting", "attempts")
def _(d):
    """Verified candidate, else the class of the latest failure."""
    return "select a.source_id, a.candidate_id, case when a.candidate_id is null then coalesce(a.failure_class, f.last_state) end as failure from accounting a left join (select transaction_id, max_by(state, sequence) as last_state from attempts group by transaction_id) f on f.transaction_id = a.source_id"


@operator("lif07_continue_after_failure", "accounting", "sources")
def _(d):
    """Every source with its outcome; failures stay as rows."""
    return "select s.source_id, coalesce(a.terminal_state, 'not_started') as terminal_state from sources s left join accounting a on a.source_id = s.source_id * 10"


@operator("lif08_target_index_build", "target_index")
def _(d):
    """Targets by key, repeated pairs once."""
    return "select doc_id, lookup_key, target_type, target_id, min(page) as page from target_index group by doc_id, lookup_key, target_type, target_id"


@operator("lif09_document_targets", "accounting")
def _(d):
    """Documents that may be referred to."""
    return "select source_id, source_ordinal, candidate_id from accounting where candidate_id is not null"


@operator("lif10_mention_manifest", "documents", "mentions")
def _(d):
    """References of every document, zeros included."""
    return "select x.doc_id, coalesce(m.n, 0) as mentions from documents x left join (select doc_id, count(*) as n from mentions group by doc_id) m on m.doc_id = x.doc_id"


@view("local_resolution", "mentions", "target_keys", "family", "document_sources")
def _(d):
    """Outcome of references within their document, first reason first: no targets for figures, tables elsewhere, targets found, targets too far, other documents of the family, other documents, none."""
    external = d.rlike("m.suffix", EXTERNAL_TABLE)
    return f"""select doc_id, seq, span_start, page, mention_class, lookup_key, case when reason is not null then 'unresolved' when candidates = 1 then 'resolved' else 'ambiguous' end as status, reason
      from (select k.doc_id, k.seq, k.span_start, k.page, k.mention_class, k.lookup_key, k.candidates, case when k.mention_class = 'figure' then 'target_type_unavailable' when k.external then 'qualified_external_table' when k.candidates > 0 then null when k.matches > 0 then 'outside_table_window'
          when k.mention_class in ('appendix', 'document') and f.alias is not null then 'deferred_cross_document' when k.mention_class = 'document' then 'external_document' else 'no_local_alias' end as reason
        from (select m.doc_id, m.seq, m.span_start, m.page, m.mention_class, m.lookup_key, m.external, count(distinct t.target_id) as matches, count(distinct case when m.mention_class <> 'table' or abs(t.page - m.page) <= {TABLE_PAGE_WINDOW} then t.target_id end) as candidates
          from (select m.*, m.mention_class = 'table' and {external} as external from mentions m) m left join target_keys t on t.doc_id = m.doc_id and t.target_type = m.mention_class and t.lookup_key = m.lookup_key
          group by m.doc_id, m.seq, m.span_start, m.page, m.mention_class, m.lookup_key, m.external) k
        left join document_sources s on s.doc_id = k.doc_id left join (select distinct root_id, alias from family) f on f.root_id = s.root_id and f.alias = k.lookup_key)"""


@operator("lif11_local_resolution", "local_resolution")
def _(d):
    """Status and reason of every reference."""
    return "select doc_id, seq, span_start, mention_class, status, reason from local_resolution"


@view("collection_resolution", "local_resolution", "family", "document_sources", "accounting")
def _(d):
    """Deferred references against the family catalogue: which source they mean, and whether it can be had."""
    return """select l.doc_id, l.seq, l.span_start, l.lookup_key, case when count(distinct f.source_id) > 1 then 'ambiguous' when count(distinct f.source_id) = 0 then 'target_not_in_scope' when max(case when a.candidate_id is not null then 1 else 0 end) = 1 then 'resolved'
        when max(case when a.terminal_state is not null then 1 else 0 end) = 1 then 'target_source_failed' else 'target_unavailable' end as status
      from local_resolution l left join document_sources s on s.doc_id = l.doc_id left join family f on f.alias = l.lookup_key and f.root_id = s.root_id left join accounting a on a.source_id = f.source_id
      where l.reason = 'deferred_cross_document' group by l.doc_id, l.seq, l.span_start, l.lookup_key"""


@operator("lif12_collection_resolution", "collection_resolution")
def _(d):
    """Outcome of references between documents."""
    return "select doc_id, seq, span_start, lookup_key, status from collection_resolution"


@operator("lif13_handoff_readiness", "accounting")
def _(d):
    """Readiness under both policies, and one reason for each failure."""
    return """select 'strict' as policy, case when count(*) filter (where terminal_state = 'failed_terminal') > 0 then 'blocked' else 'ready' end as state, count(*) filter (where terminal_state = 'failed_terminal') as reasons from accounting
      union all select 'permissive', 'ready', count(*) filter (where terminal_state = 'failed_terminal') from accounting"""


@operator("lif15_typed_identity", "accounting")
def _(d):
    """Typed ids of collection records."""
    j = """'{"candidate":"' || coalesce(candidate_id, '') || '","source":' || cast(source_id as string) || '}'"""
    return f"select source_id, 'idx-' || {d.sha256(j)} as index_id, 'lnk-' || {d.sha256(j)} as link_id from accounting"


@operator("lif16_report_facts", "accounting", "collection_resolution")
def _(d):
    """Facts of the collection report: failures and unresolved references."""
    return "select 'failure' as fact, coalesce(failure_class, 'unknown') as detail, count(*) as n from accounting where terminal_state = 'failed_terminal' group by coalesce(failure_class, 'unknown') union all select 'mention', status, count(*) from collection_resolution where status <> 'resolved' group by status"


@operator("lif17_anomaly_records", "anomalies")
def _(d):
    """Anomalies with a stable digest."""
    return f"select record_id, 'document:' || category as category, {d.sha256('''category || ':' || cast(record_id as string)''')} as digest from anomalies"


@operator("lif18_content_anomalies", "items")
def _(d):
    """Content errors, warnings and abstentions."""
    return "select doc_id, seq, 'empty_text' as code, 'warning' as severity from items where line = '' union all select doc_id, seq, 'long_line', 'warning' from items where length(line) > 600 union all select doc_id, seq, 'no_level', 'abstention' from items where role = 'section_header' and level is null"


@operator("lif20_replay_audit", "baseline_rows", "candidate_rows")
def _(d):
    """Rows before and after a replay."""
    return "select role, sum(before_n) as before_rows, sum(after_n) as after_rows from (select coalesce(role, 'none') as role, 1 as before_n, 0 as after_n from baseline_rows union all select coalesce(role, 'none'), 0, 1 from candidate_rows) group by role"


@operator("lif21_stage_lineage", "stage_digests")
def _(d):
    """Neighbouring stages whose digests do not link."""
    return "select transaction_id, sequence from (select transaction_id, sequence, upstream, lag(sha) over (partition by transaction_id order by sequence) as before from stage_digests) where before is not null and before <> upstream"


@operator("lif22_review_requests", "review_pages")
def _(d):
    """Pages to review of each document."""
    return f"select doc_id, {d.listagg('cast(page as string)', 'page')} as pages from review_pages group by doc_id"


@operator("lif23_page_outcomes", "requested_pages", "produced_pages", "flt10_page_route")
def _(d):
    """One outcome for every requested page."""
    return """select p.doc_id, p.page, case when m.page is null then 'missing' else r.route end as outcome from requested_pages p left join produced_pages m on m.doc_id = p.doc_id and m.page = p.page
      left join flt10_page_route r on r.doc_id = p.doc_id and r.page = p.page"""


@operator("prj01_feature_rows", "items", "parsed_numbers", "outline_matches", "jn03_alignment_lookup")
def _(d):
    """Items as feature rows in reading order, with the evidence of number, outline and page layout."""
    return """select i.doc_id, i.seq as reading_order_index, i.page as physical_page, i.role as raw_role, i.layer as content_layer, i.level as raw_level, lower(trim(i.line)) as normalized_text, i.left_pt, i.in_picture, i.n_regions,
      n.kind as numbering_kind, n.token as numbering_token, n.depth as numbering_depth, coalesce(o.outline_state, 'absent') as outline_state, o.outline_level, a.layout_state, length(i.line) as text_length, i.line = '' as empty_text
      from items i left join parsed_numbers n on n.doc_id = i.doc_id and n.seq = i.seq left join outline_matches o on o.doc_id = i.doc_id and o.seq = i.seq left join jn03_alignment_lookup a on a.doc_id = i.doc_id and a.seq = i.seq"""


@operator("prj02_level_overlay", "headings")
def _(d):
    """Levels other than 1 as patch rows."""
    return "select doc_id, seq as ref, level from headings where level <> 1"


@operator("prj03_overlay_apply", "headings", "prj02_level_overlay")
def _(d):
    """Base levels of 1 with the patch applied."""
    return "select h.doc_id, h.seq, coalesce(o.level, 1) as level from headings h left join prj02_level_overlay o on o.doc_id = h.doc_id and o.ref = h.seq"


@operator("prj04_page_alignment", "page_alignment")
def _(d):
    """Lines of pages, unique or ambiguous."""
    return "select doc_id, page, norm, state, line_size from page_alignment"


@view("region_reasons", "boxes")
def _(d):
    """Regions with the first reason to reject them."""
    return "select box_id, part_no, case when not page_known then 'unknown_page' when l is null or r <= l or t <= b then 'non_finite_or_missing_bbox' when l < 0 or b < 0 or r > 612 or t > 792 then 'out_of_page_bounds' end as reason from boxes"


@operator("prj05_region_projection", "region_reasons")
def _(d):
    """Valid and rejected regions."""
    return "select box_id, part_no, reason is null as valid, reason from region_reasons"


@view("clean_cells", "cells", "removed_lines")
def _(d):
    """Cells of kept rows and columns with new indexes."""
    return """select x.table_id, cast(dense_rank() over (partition by x.table_id order by x.r) - 1 as bigint) as row_index, cast(dense_rank() over (partition by x.table_id order by x.c) - 1 as bigint) as column_index, x.text from cells x
      left join removed_lines a on a.table_id = x.table_id and a.axis = 'row' and a.place = x.r left join removed_lines b on b.table_id = x.table_id and b.axis = 'column' and b.place = x.c where a.place is null and b.place is null"""


@operator("prj06_clean_table", "clean_cells")
def _(d):
    """Cleaned tables, re-indexed."""
    return "select table_id, row_index, column_index, text from clean_cells"


@operator("prj07_span_projection", "cell_spans", "removed_lines")
def _(d):
    """Spans cut to the kept rows: extent and whether it still is a rectangle."""
    span = d.series("cell_spans", "row_no", "first_row", "last_row")
    if d.name == "spark":
        kept = f"(select s.table_id, s.first_row, s.row_no from {d.dealt(span, 'table_id', 'row_no')} s left anti join {d.dealt("(select table_id, place from removed_lines where axis = 'row')", 'table_id', 'place')} g on g.table_id = s.table_id and g.place = s.row_no)"
        return f"select table_id, first_row, min(row_no) as lo, max(row_no) as hi, count(*) = max(row_no) - min(row_no) + 1 as rectangle from {d.dealt(kept, 'table_id', 'first_row')} group by table_id, first_row"
    return f"""select s.table_id, s.first_row, min(s.row_no) as lo, max(s.row_no) as hi, count(*) = max(s.row_no) - min(s.row_no) + 1 as rectangle from {span} s
      left join removed_lines g on g.table_id = s.table_id and g.axis = 'row' and g.place = s.row_no where g.place is null group by s.table_id, s.first_row"""


@operator("prj08_canonical_tables", "table_kinds")
def _(d):
    """Tables without document indexes, and families that are excluded as a whole."""
    return "select family_id, count(*) filter (where kind = 'document_index') as excluded, count(*) as members, count(*) filter (where kind = 'document_index') = count(*) as family_excluded from table_kinds group by family_id"


@operator("prj09_logical_tables", "fragments")
def _(d):
    """Tables without continuation fragments that hold a header only."""
    return "select table_id, rows_ as rows from fragments where not (rows_ = 1 and continues)"


@operator("prj10_content_records", "items")
def _(d):
    """Blocks with their ids."""
    return f"select doc_id, {d.padded_id(chr(39) + 'blk-' + chr(39), 'seq + 1')} as id, seq as sequence, layer as content_layer, line as canonical_text from items where role <> 'page_footer'"


@operator("prj11_support_records", "items")
def _(d):
    """Pages of documents."""
    return "select doc_id, page as physical_page_number, count(*) as items, case when count(*) filter (where layer = 'body') = 0 then 'no_body_content' end as unmapped_reason from items group by doc_id, page"


@operator("prj12_namespace_remap", "accounting")
def _(d):
    """Candidate ids moved to another namespace."""
    return "select source_id, replace(candidate_id, 'dconv1-', 'dconv2-') as candidate_id from accounting"


@operator("prj13_alias_fanout", "target_index")
def _(d):
    """One index row for every target of an alias."""
    return "select doc_id, 'alias-' || lookup_key as alias_id, target_type, target_id from target_index"


@operator("prj14_accounting_rows", "accounting")
def _(d):
    """Accounting rows from terminal evidence."""
    return "select source_id, source_ordinal, terminal_state, candidate_id, failure_class from accounting"


@operator("prj15_inherited_headers", "headers", "column_types")
def _(d):
    """Header evidence that a continuation inherits: digest and columns without a type."""
    return f"select h.table_id, {d.sha256('h.header')} as header_sha256, count(*) filter (where t.dominant = 'empty') as unrepresented from headers h join column_types t on t.table_id = h.table_id group by h.table_id, h.header"


@operator("prj16_review_matrix", "cells")
def _(d):
    """Rows of a table as text, cell by cell."""
    return f"select table_id, r, {d.listagg('text', 'c', '|')} as row_text from cells group by table_id, r"


@operator("prj17_crop_to_points", "boxes")
def _(d):
    """Pixels of a crop at 144 dots an inch to page points, and back."""
    return "select box_id, part_no, l / 2 + 10 as l_pt, 792 - (t / 2 + 20) as b_pt, (l / 2 + 10 - 10) * 2 as l_px from boxes"


@operator("prj18_stable_references", "items")
def _(d):
    """Pointers as stable references, image links as digests."""
    return f"select doc_id, seq, 'key-' || substr({d.sha256('line')}, 1, 12) as stable_ref, {d.sha256(''''img://' || cast(seq as string)''')} as image_digest from items"


@operator("prj19_sequential_ids", "items")
def _(d):
    """Ids by rank after the order is known."""
    return f"select doc_id, seq, {d.padded_id(chr(39) + 'fig-' + chr(39), 'n')} as id from (select doc_id, seq, row_number() over (partition by doc_id order by page desc, seq) as n from items where role = 'list_item')"


@operator("prj20_asset_ordinals", "assets")
def _(d):
    """Assets of a page numbered by role."""
    return "select page_id, position, role, cast(row_number() over (partition by page_id, role order by position) as bigint) as ordinal from assets"


@operator("prj21_warnings", "anomalies", "win06_sparse_depth")
def _(d):
    """Warnings of all products, each at its first appearance."""
    return "select source_id, code, min(at_) as first_at from (select source_id, category as code, record_id as at_ from anomalies union all select cast(doc_id % 40 as bigint), 'sparse_depth', doc_id * 4294967296 + seq from win06_sparse_depth) group by source_id, code"


@operator("prj22_run_metrics", "documents")
def _(d):
    """Cost against the producer by source."""
    return "select source, round(sum(n_chars) / cast(sum(n_chars + 500) as double), 6) as byte_ratio, sum(n_chars) < 200 * count(*) as cheaper from documents group by source"


@operator("prj23_mapping_summary", "items", "mentions", "links")
def _(d):
    """Rows mapped by family."""
    return "select 'items' as family, count(*) as n from items union all select 'mentions', count(*) from mentions union all select 'links', count(*) from links"


@operator("prj24_mixed_stream", "items", "page_tables")
def _(d):
    """Blocks and tables of a document in one order by page and place."""
    return "select doc_id, kind, id, cast(row_number() over (partition by doc_id order by page, kind, id) as bigint) as position from (select doc_id, 'block' as kind, seq as id, page from items union all select doc_id, 'table', table_id, page from page_tables)"


@operator("prj25_table_requests", "flt10_page_route")
def _(d):
    """Pages with a positive route."""
    return "select doc_id, page, route from flt10_page_route where route <> 'no_table_route'"


@operator("src08_page_links", "links")
def _(d):
    """Document links of landing pages in order."""
    return "select page_id, position, href from links"


@operator("src08_duplicate_links", "links")
def _(d):
    """Links that a page has more than once."""
    return "select page_id, href, count(*) as n from links group by page_id, href having count(*) > 1"


@operator("src09_host_allow_list", "pages", "allowed_hosts")
def _(d):
    """Addresses whose host is allowed."""
    return "select p.page_id, p.host, h.host is not null as allowed from (select page_id, regexp_extract(url, '^https?://([^/:]+)', 1) as host from pages) p left join allowed_hosts h on h.host = p.host"
