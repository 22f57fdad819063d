"""Validation: each check returns the violations of a policy; no rows means that it holds."""

from __future__ import annotations

from folioforge.plans.catalog import operator

CHECKS = {
    "val01_region_bounds": (("boxes",), "Regions outside their page.", "select box_id, part_no, 'bounds' as violation from boxes where page_known and (l < 0 or b < 0 or r > 612 or t > 792)"),
    "val03_table_family_once": (("family_members", "tables"), "Tables that are not in exactly one family.", 'select t.table_id, count(f.family_id) as families from tables t left join family_members f on f.table_id = t.table_id group by t.table_id having count(f.family_id) <> 1'),
    "val04_cell_coverage": (("placed_cells", "grid"), "Grid places covered other than once.", 'select table_id, r, c, count(*) as covered from placed_cells group by table_id, r, c having count(*) <> 1'),
    "val05_unmapped_reasons": (("page_mappings",), "Pages without mapping and without a reason, or with both.", 'select doc_id, page from page_mappings where (mapped = 0) <> (reason is not null)'),
    "val06_explained_text": (("canonical_texts",), "Canonical texts that the declared normalisation of the native text does not explain.", "select doc_id, seq from canonical_texts where canonical_text <> trim(replace(native_text, '  ', ' '))"),
    "val07_page_content_lists": (("items", "page_contents"), "Pages whose list of contents misses an item, or has one that is not there.", 'select coalesce(i.doc_id, l.doc_id) as doc_id, coalesce(i.page, l.page) as page, count(*) filter (where l.seq is null) as missing, count(*) filter (where i.seq is null) as extra from items i full outer join page_contents l on l.doc_id = i.doc_id and l.page = i.page and l.seq = i.seq where l.seq is null or i.seq is null group by coalesce(i.doc_id, l.doc_id), coalesce(i.page, l.page)'),
    "val08_cross_document_relations": (("tree",), "Relations between documents of different languages.", "select c.id, p.id as parent_id from tree c join tree p on c.parent_id = p.id where c.label <> p.label"),
    "val09_lineage_coverage": (("mentions", "lineage"), "References whose source item is not in the lineage.", 'select m.doc_id, m.seq, m.span_start from mentions m where not exists (select 1 from lineage i where i.doc_id = m.doc_id and i.seq = m.seq)'),
    "val10_status_target_count": (("recorded_links", "mention_candidates"), "Recorded statuses that disagree with the number of targets.", "select r.doc_id, r.seq, r.span_start, r.status, coalesce(c.n, 0) as targets from recorded_links r left join (select doc_id, seq, span_start, count(distinct target_id) as n from mention_candidates group by doc_id, seq, span_start) c on c.doc_id = r.doc_id and c.seq = r.seq and c.span_start = r.span_start where (r.status = 'resolved') <> (coalesce(c.n, 0) = 1) or (r.status = 'ambiguous') <> (coalesce(c.n, 0) > 1)"),
    "val12_hierarchy_rederivation": (("recorded_parents", "heading_parents"), "Recorded parents that differ from those derived, and headings that only one side has.", 'select coalesce(r.doc_id, p.doc_id) as doc_id, coalesce(r.seq, p.seq) as seq, r.parent_seq as recorded, p.parent_seq as derived from recorded_parents r full outer join heading_parents p on p.doc_id = r.doc_id and p.seq = r.seq where r.seq is null or p.seq is null or r.parent_seq is distinct from p.parent_seq'),
    "val13_regime_topology": (("recorded_scopes",), "Scopes that overlap without one holding the other: an earlier one still open at a start ends before the later one does.", 'select doc_id, start_seq, end_seq from (select *, max(end_seq) over (partition by doc_id order by start_seq, end_seq desc rows between unbounded preceding and 1 preceding) as open_until from recorded_scopes) where open_until > start_seq and open_until < end_seq'),
    "val14_toc_order": (("win07_toc_order_conflict",), "Contents rows out of order.", "select doc_id, seq, target_seq from win07_toc_order_conflict where conflict"),
    "val15_page_label_policy": (("recorded_labels", "page_label_evidence"), "Recorded label resolutions that the evidence does not allow.", "select r.doc_id, r.page, r.resolution from recorded_labels r join page_label_evidence e on e.doc_id = r.doc_id and e.page = r.page where r.resolution <> case when e.explicit_state = 'conflict' or e.visible_state = 'conflict' then 'conflict' when e.explicit_state = 'present' then 'explicit' when e.visible_state = 'present' then 'visible' else 'unknown' end"),
    "val16_table_resolution": (("recorded_table_links", "target_index"), "Recorded table targets that are not in the index, or outside the page window.", "select r.doc_id, r.seq, r.span_start, r.target_id, min(abs(t.page - r.page)) as distance from recorded_table_links r left join target_index t on t.doc_id = r.doc_id and t.target_id = r.target_id and t.target_type = 'table' group by r.doc_id, r.seq, r.span_start, r.target_id having count(t.target_id) = 0 or min(abs(t.page - r.page)) > 10"),
    "val17_collection_counts": (("recorded_counts", "candidates"), "Recorded outcome counts that differ from the candidates'.", 'select coalesce(r.terminal_state, c.terminal_state) as terminal_state, r.n as recorded, c.n as counted from recorded_counts r full outer join (select terminal_state, count(*) as n from candidates group by terminal_state) c on c.terminal_state = r.terminal_state where r.n is distinct from c.n'),
    "val18_table_stage_summary": (("tables", "stage_summary"), "Pages whose table count differs from the summary.", 'select coalesce(t.page, f.page) as page, t.n, f.n_tables from (select page, count(*) as n from tables group by page) t full outer join stage_summary f on f.page = t.page where t.n is distinct from f.n_tables'),
    "val21_conversion_accounting": (("converted_pages",), "Documents whose pages are not contiguous.", 'select doc_id, count(distinct page) as pages, max(page) as last_page from converted_pages group by doc_id having count(distinct page) <> max(page) or min(page) <> 1'),
    "val24_declared_differences": (("row_differences",), "Differences in fields that may not change.", "select source_id, field from row_differences where field not in ('row', 'pages')"),
    "val25_stage_envelopes": (("envelopes",), "Completed stages without a completion, or the reverse.", "select transaction_id, sequence from envelopes where (state in ('complete', 'complete_with_warnings')) <> (completion is not null)"),
    "val26_input_agreement": (("baseline_rows", "candidate_rows"), "Inputs that name the same source differently.", "select a.source_id from baseline_rows a join candidate_rows b on a.source_id = b.source_id where a.title is distinct from b.title or a.role is distinct from b.role"),
}


def _fixed(sql: str):
    return lambda d: sql


for _name, (_inputs, _doc, _sql) in CHECKS.items():
    _f = _fixed(_sql)
    _f.__doc__ = _doc
    operator(_name, *_inputs)(_f)


@operator("val11_id_grammar", "recorded_ids")
def _(d):
    """Ids that do not follow the grammar, and ids used twice."""
    return f"""select id, 'grammar' as violation, count(*) as n from recorded_ids where not {d.rlike('id', '^exv1-[0-9]+-(blk|sec|fur)-[0-9]{6,}$')} group by id
      union all select id, 'repeated', count(*) from recorded_ids group by id having count(*) > 1"""
