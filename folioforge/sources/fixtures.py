"""Document-structure relations derived from the generic tables, so that every operator has input of its own shape."""

from __future__ import annotations

from folioforge.operators.predicates import ELIGIBLE, disposition, exclusion
from folioforge.plans.catalog import view


@view("lines", "documents")
def _(d):
    """Lines of documents with their place."""
    return d.split_lines()


@view("items", "lines")
def _(d):
    """Reading-order items: page, role, layer, heading level, place, owner, number of regions, a text with a number (``ntext``) and a text with references (``mtext``).

    The texts are whole lines with a number before or references after; some are the blocks that searches leave out.
    """
    k = "(doc_id + seq)"
    after_section = f"case {k} % 6 when 0 then ' of the Clean Water Act' when 1 then ' of this Agreement' when 2 then ' of the Final EIR' when 3 then ' of the Health Code' when 4 then ' of the Urban Water Management Plan' else '' end"
    number = "case when seq % 5 = 0 then '15126.2' else cast(doc_id % 5 + 1 as string) || '.' || cast(seq % 3 + 1 as string) end"
    references = f"""' see Section ' || {number} || {after_section} || ', Table ' || cast(seq % 6 + 1 as string) || case seq % 4 when 0 then ' in reference 3' when 1 then ' of Reference 12' else '' end
        || case when seq % 3 = 0 then ', Figure 2-' || cast(seq % 9 + 1 as string) else '' end || ' and Appendix ' || chr(cast(65 + doc_id % 4 as int))
        || case seq % 5 when 1 then ', page ' || cast(page as string) when 2 then ', Page iv' when 3 then ', Page ' || cast(page as string) || ' of 40' else '' end
        || case when {k} % 9 = 0 then ', Final EIR for the Bay Delta Plan (2019)' else '' end || '.'"""
    block = f"""case {k} % 23 when 0 then ' Page ' || cast(page as string) || ' of 40' when 1 then 'Table ' || cast(seq % 6 + 1 as string) || '-a' when 2 then 'Smith & Jones, 2019. ' || line || {references}
        when 3 then line || ' recorded on 4 May in Book 7 of Official Records at page 12,' || {references} else line || {references} end"""
    numbered = f"case when seq % 2 = 1 then line else case {k} % 7 when 0 then cast(seq % 120 as string) || '. ' || line when 1 then cast(seq % 9 as string) || '.2.1 ' || line when 2 then 'Article IV ' || line when 3 then 'XI. ' || line when 4 then 'B. ' || line when 5 then '• ' || line else line end end"
    return f"""select *, {numbered} as ntext, {block} as mtext from (select doc_id, seq, cast(floor(seq / 8) as bigint) + 1 as page, line,
      case when seq % 8 = 7 then 'page_footer' when {k} % 5 = 0 then 'section_header' when {k} % 7 = 3 then 'list_item' when {k} % 13 = 6 then 'caption' else 'text' end as role,
      case when seq % 8 = 7 then 'furniture' else 'body' end as layer,
      case when seq % 8 <> 7 and {k} % 5 = 0 then cast((doc_id * 3 + seq) % 4 + 1 as bigint) end as level,
      cast(case when {k} % 7 = 3 then 96 else 72 end + seq % 3 as double) as left_pt, {k} % 37 = 5 as in_picture, case when {k} % 3 = 0 then 2 else 1 end as n_regions from lines)"""


@view("links", "pages")
def _(d):
    """Anchors of web pages in order."""
    m = d.matches("pages", "html", '<a href="([^"]*)"', 1, "href")
    return f"select page_id, cast(position_1 as bigint) as position, href from {m}"


@view("attempts", "events")
def _(d):
    """State events of processing attempts with the producer's raw status and the source that they are of."""
    return """select transaction_id, sequence, state, case when sequence % 19 = 0 then 'SUCCESS' when state = 'selected' then 'PENDING' when state = 'running' then 'STARTED' when state in ('complete', 'complete_with_warnings') then 'SUCCESS' when state = 'cancelled' then null else 'FAILURE' end as raw_status,
      case when sequence = 7 and transaction_id % 5 = 0 then transaction_id + 1 else transaction_id end as source_id
      from (select cast(user_id as bigint) as transaction_id, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as sequence,
        case when event_id % 13 = 0 then 'failed_terminal' when event_id % 13 = 1 then 'cancelled' else case event_type when 'signup' then 'selected' when 'view' then 'running' when 'click' then 'complete'
             when 'purchase' then 'complete_with_warnings' else 'failed_retryable' end end as state from events)"""


@view("histories", "attempts")
def _(d):
    """Histories of which some have lost events."""
    return "select transaction_id, sequence, state, raw_status, source_id from attempts where sequence % 7 <> 3"


@view("failures", "events")
def _(d):
    """Errors that ended attempts."""
    return """select event_id, case cast(event_id % 8 as int) when 0 then 'TimeoutError' when 1 then 'FileNotFoundError' when 2 then 'PermissionError' when 3 then 'ValidationError' when 4 then 'HierarchyAuthorizationError'
      when 5 then 'SourceIdentityError' when 6 then 'OSError' else 'RuntimeError' end as error_type from events"""


@view("conversions", "events")
def _(d):
    """Raw outcomes of the converter."""
    return """select event_id, case event_type when 'view' then 'success' when 'click' then 'success' when 'purchase' then 'partial_success' when 'signup' then 'started' else 'failure' end as raw_status,
      case when value > 90 then 1 else 0 end as errors, case when value > 60 then 1 else 0 end as warnings from events"""


@view("tables", "orders")
def _(d):
    """Table records: page and place on the page."""
    return """select o_orderkey as table_id, cast(floor(o_orderkey / 4) as bigint) as page,
      cast(row_number() over (partition by cast(floor(o_orderkey / 4) as bigint) order by o_orderkey) as bigint) as page_table_index,
      o_totalprice as price, o_custkey as custkey from orders"""


@view("grid", "lineitem")
def _(d):
    """Rows of tables before they are laid out in cells."""
    return """select l_orderkey as table_id, l_returnflag, l_linestatus, l_quantity, l_discount, l_partkey,
      cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as bigint) as r from lineitem"""


def _cell_texts() -> list[str]:
    """Texts of a row's cells, column by column."""
    texts = ("case when r = 1 and table_id % 6 = 1 then 'extract_v2' when r > 1 and table_id % 9 = 4 and l_partkey % 4 = 0 then 'Sheet 3 of 12' when {0} then 'Flag' else l_returnflag end", "case when {0} then 'Status' else l_linestatus end",
        "case when {0} then 'Quantity' else cast(cast(round(l_quantity) as bigint) as string) end", "case when {0} then 'Discount' when l_discount = 0 then '-' else cast(cast(round(l_discount * 100) as bigint) as string) end",
        "case when {0} then 'Part ' || cast(cast(floor(table_id / 5) as bigint) as string) when l_partkey % 5 = 0 then '' else cast(l_partkey as string) end")
    return [t.format("r = 1 and table_id % 4 <> 3") for t in texts]


@view("cells", "grid")
def _(d):
    """Cells of tables in long form, in one scan."""
    return f"select table_id, r, x.c as c, x.text as text from {d.exploded('grid', 'x', *(d.struct(c=str(c), text=t) for c, t in enumerate(_cell_texts())))}"


@view("cell_rows", "grid")
def _(d):
    """The same cells, one row of a table in each row."""
    return f"select table_id, r, {d.text_list(*_cell_texts())} as texts from grid"


@view("boxes", "lineitem")
def _(d):
    """Boxes on pages of 612 by 792 points; a third lies on unknown pages."""
    return """select l_orderkey as box_id, l_linenumber as part_no, cast(l_orderkey % 97 as bigint) as page, l_orderkey % 3 <> 0 as page_known,
      cast(l_quantity * 2 as double) as l, cast(l_quantity * 2 + 50 + l_discount * 100 as double) as r,
      cast(l_suppkey % 60 as double) * 10 as b, cast(l_suppkey % 60 as double) * 10 + l_quantity * 6 as t from lineitem"""


@view("sources", "supplier")
def _(d):
    """Source release: role and page count."""
    return """select cast(s_suppkey as bigint) as source_id, s_name as title, cast(s_suppkey % 300 + 1 as bigint) as pages, cast(round(abs(s_acctbal) * 100) as bigint) as bytes,
      case s_nationkey % 4 when 0 then 'model_corpus' when 1 then 'curator_only_response_source' when 2 then 'curator_qa_original_submission'
           else 'recovery_qa_duplicate' end as role from supplier"""


@view("roles")
def _(d):
    """The closed set of source roles."""
    return "select * from (values ('model_corpus'), ('curator_only_response_source'), ('curator_qa_original_submission'), ('recovery_qa_duplicate')) v(role)"


@view("family", "nation")
def _(d):
    """Source family catalogue: root, role and alias."""
    return """select cast(n_nationkey as bigint) as source_id, cast(n_regionkey as bigint) as root_id,
      case when n_nationkey < 5 then 'root_report' when n_nationkey % 2 = 0 then 'top_level_appendix' else 'appendix_part' end as role,
      case when n_nationkey < 5 then 'final eir for the bay delta plan' else 'appendix ' || lower(chr(cast(65 + n_nationkey % 6 as int))) end as alias from nation"""


@view("headings", "items")
def _(d):
    """Headings of documents."""
    return "select doc_id, seq, page, level, line as title from items where role = 'section_header' and layer = 'body'"


# The surfaces of references, in one pattern. A document's name ends where its citation begins.
LABEL = r"[1-9][0-9]*(?:[.-][A-Za-z0-9]+)*"
REFERENCE = (
    r"\b(?:(?:Draft|Final) EIR for (?:the )?[A-Z][A-Za-z0-9&'’.-]*(?:\s+[A-Z][A-Za-z0-9&'’.-]*)+\s*\(|Section\s+[1-9][0-9]*(?:\.[0-9]+)*\b|Appendix\s+[A-Z](?:[.-][A-Za-z0-9]+)*\b"
    rf"|Table\s+{LABEL}\b|Figure\s+{LABEL}\b|[Pp][Aa][Gg][Ee]\s+(?:[ivxlcdmIVXLCDM]+|[1-9][0-9]*)\b)"
)


@view("references_found", "items")
def _(d):
    """References of all items, every match of the grammar: class, spelling, half-open span in code points, what stands around it, lookup key; and what is known of the item. One scan, one pass over the text."""
    raw = d.replace_all("raw", r"\s*\($", "")
    token = f"lower({d.part('raw_text', r'\s(\S+)$', 1)})"
    known = f"(select doc_id, seq, page, mtext, {ELIGIBLE} as eligible, {exclusion(d)} as excluded_by from items)"
    return f"""select doc_id, seq, page, eligible, excluded_by, mention_class, raw_text, span_start, span_end, substr(mtext, cast(span_end + 1 as int)) as suffix, substr(mtext, cast(greatest(1, span_start - 63) as int), cast(least(64, span_start) as int)) as prefix,
      case mention_class when 'document' then lower(raw_text) when 'section' then {token} when 'printed_page' then {token} else mention_class || ' ' || {token} end as lookup_key
      from (select *, cast(at_ as bigint) as span_start, cast(at_ + length(raw_text) as bigint) as span_end, case lower(substr(raw_text, 1, 4)) when 'sect' then 'section' when 'appe' then 'appendix' when 'tabl' then 'table' when 'figu' then 'figure' when 'page' then 'printed_page' else 'document' end as mention_class
        from (select *, {raw} as raw_text from {d.spans(known, 'mtext', REFERENCE)}))"""


@view("mentions", "references_found")
def _(d):
    """References that count: in items that are searched, not in blocks that are left out, and neither statutory nor external nor page furniture."""
    return f"select doc_id, seq, page, mention_class, raw_text, span_start, span_end, suffix, prefix, lookup_key from references_found where eligible and excluded_by is null and {disposition(d)} = 'local'"


@view("later_candidates", "candidates")
def _(d):
    """Candidates of a later run, in which some sources fare otherwise and some are gone."""
    return "select source_id, case when source_id % 7 = 2 then 'failed_terminal' else terminal_state end as terminal_state, case when source_id % 7 = 2 and source_id % 2 = 0 then 'crash' else failure_class end as failure_class from candidates where source_id % 11 <> 5"


@view("candidates", "customer")
def _(d):
    """Collection candidates with a terminal state."""
    return """select cast(c_custkey as bigint) as source_id, cast(c_custkey as bigint) as source_ordinal, 'dconv1-' || cast(c_custkey as string) as candidate_id,
      case c_nationkey % 4 when 0 then 'complete' when 1 then 'complete_with_warnings' when 2 then 'complete' else 'failed_terminal' end as terminal_state,
      case when c_nationkey % 4 = 3 then 'timeout' end as failure_class from customer"""


@view("tree", "documents")
def _(d):
    """A parent tree over documents, with 0 as root."""
    return "select doc_id as id, case when doc_id = 0 then null else cast(floor((doc_id - 1) / 4) as bigint) end as parent_id, lang as label from documents"


@view("regimes", "headings")
def _(d):
    """Numbering scopes: from each level-1 heading to the next of the document."""
    return """select doc_id, seq as start_seq, coalesce(lead(seq) over (partition by doc_id order by seq), 4294967296) as end_seq,
      cast(row_number() over (partition by doc_id order by seq) as bigint) as regime_no from headings where level = 1"""


@view("document_sources", "documents")
def _(d):
    """The source family that a document belongs to."""
    return "select doc_id, cast(doc_id % 5 as bigint) as root_id from documents"


@view("table_labels", "items")
def _(d):
    """Labels on pages that a table may belong to."""
    return "select doc_id, page, seq from items where role = 'list_item'"


@view("page_tables", "tables", "documents")
def _(d):
    """Tables by the document and page that they stand on."""
    return "select cast(table_id % 1000 as bigint) as doc_id, cast(table_id % 7 as bigint) + 1 as page, table_id, page_table_index from tables"


@view("table_edges", "boxes")
def _(d):
    """Tables at page edges: how far down they end and up they begin, their span and column boundaries as shares of the width."""
    def columns(l: str, w: str) -> str:
        return d.text_list(*(f"cast(({l} + {w} * {k} / 3) / 612 as double)" for k in range(4)))

    return f"""select box_id, part_no, case when part_no % 2 = 1 then b / 3960 else b / 792 end as bottom_fraction, case when part_no % 2 = 0 then 0.8 + t / 7920 else t / 792 end as top_fraction,
      case when box_id % 2 = 0 then 0.2 else l / 612 end as left_fraction, case when box_id % 2 = 0 then 0.7 + part_no / 200.0 else r / 612 end as right_fraction,
      case when box_id % 2 = 0 then {columns("cast(120 as double)", "(300 + part_no)")} else {columns("l", "(r - l)")} end as boundaries from boxes"""


@view("page_measures", "page_features")
def _(d):
    """Measured shares of pages that decide their route."""
    return """select doc_id, page, regions, width_fraction, ((doc_id + page) % 8 + 1) / cast(8 as double) as height_fraction, nonempty_lines * ((doc_id + page) % 14) as nonempty_lines,
      ((doc_id + page * 5) % 7) * cast(0.005 as double) as density, ((doc_id * 7 + page * 3) % 10) / cast(10 as double) as digit_fraction from page_features"""


@view("layout_regions", "boxes")
def _(d):
    """Regions that the layout names tables."""
    return "select page, page_known, box_id, part_no, l, b, r, t from boxes where part_no <= 2"


@view("page_marks", "boxes")
def _(d):
    """Texts near tables by role, with tables among them."""
    return "select page, box_id, part_no, case part_no when 1 then 'table' when 2 then 'caption' when 3 then 'section_header' else 'text' end as role, case when part_no in (2, 3) then b + 500 else b end as b, case when part_no in (2, 3) then t + 500 else t end as t from boxes where page_known"


@view("ruled_regions", "boxes")
def _(d):
    """Ruled regions in pixels with the crossings of their lines."""
    return "select box_id, part_no, r - l as width, (t - b) / 8 as height, cast(part_no as bigint) + 1 as intersections from boxes"


@view("network_boxes", "boxes")
def _(d):
    """Boxes of a parser that needs no rulings."""
    return "select distinct box_id, part_no, l, b, r, t from boxes where part_no > 3"


@view("ruled_boxes", "boxes")
def _(d):
    """Boxes that rulings enclose."""
    return "select box_id, l, b, r, t from boxes where part_no <= 3"


@view("bibliography_sections", "tree")
def _(d):
    """Sections that hold a bibliography."""
    return "select id from tree where id % 7 = 3 and label = 'en'"


@view("heading_texts", "headings")
def _(d):
    """Headings with a marker before and a dot leader and page after the whole title."""
    return "select doc_id, seq, cast(seq % 7 + 1 as string) || '.' || cast(level as string) || ' ' || title || ' ..... ' || cast(page as string) as t from headings"


@view("page_footers", "items")
def _(d):
    """Footers with counters, some after an older one."""
    return "select doc_id, seq, case when seq % 16 = 7 then 'C-1 Page 1 of 2; ' else '' end || 'C-' || cast(doc_id % 9 as string) || ' Page ' || cast(page as string) || ' of ' || cast(page + 3 as string) as t from items where role = 'page_footer'"


@view("classifier_fields", "events")
def _(d):
    """Seven fields of which the first that is present classifies a record."""
    names = ("error_class", "warning_code", "reason", "status", "outcome", "kind", "category")
    return "select event_id, " + ", ".join(f"case when event_id % {k + 2} = 0 then '' when event_id % {k + 2} = 1 then null else '{n}' end as {n}" for k, n in enumerate(names)) + " from events"


@view("removed_lines", "grid")
def _(d):
    """Rows and columns that cleaning takes out of tables."""
    return "select distinct table_id, 'row' as axis, r as place from grid where r % 5 = 0 union all select distinct table_id, 'column', cast(1 as bigint) from grid"


@view("cell_spans", "grid")
def _(d):
    """Cells that span rows."""
    return "select table_id, r as first_row, r + l_partkey % 3 as last_row from grid"


@view("table_kinds", "tables")
def _(d):
    """Tables by what the converter took them for."""
    return "select page as family_id, table_id, case when table_id % 7 = 0 then 'document_index' else 'table' end as kind from tables"


@view("fragments", "headers", "grid")
def _(d):
    """Tables with their rows and whether they continue an earlier one."""
    return "select h.table_id, g.n as rows_, h.table_id % 2 = 1 as continues from headers h join (select table_id, count(*) as n from grid group by table_id) g on g.table_id = h.table_id"


@view("assets", "links")
def _(d):
    """Files beside documents by role."""
    return "select page_id, position, case when position % 2 = 0 then 'image' else 'source' end as role from links"


@view("replacements", "items")
def _(d):
    """Causes for which texts are replaced."""
    return "select doc_id, seq, 'table' as cause from items where seq % 4 = 0 union all select doc_id, seq, 'figure' from items where seq % 6 = 0 union all select doc_id, seq, 'invalid_region' from items where seq % 9 = 0"


@view("body_events", "items")
def _(d):
    """Body items as events in document order."""
    return "select doc_id, seq, page from items where layer = 'body'"


@view("selection", "sources")
def _(d):
    """A frozen selection of sources."""
    return "select source_id from sources where source_id % 4 <> 0"


@view("manifest_sources", "sources")
def _(d):
    """Sources that a manifest lists."""
    return "select source_id from sources where source_id % 3 <> 0"


@view("aligned_boxes", "boxes")
def _(d):
    """The boxes of a second producer: a quarter point aside, some missing."""
    return "select box_id, part_no, page, l + 0.25 as l, r + 0.25 as r, b, t from boxes where part_no <> 3"


@view("tree_a", "links")
def _(d):
    """Files of one tree with digests."""
    return f"select href, {d.sha256('cast(min(position) as string)')} as digest from links where page_id % 3 <> 0 group by href"


@view("tree_b", "links")
def _(d):
    """Files of another tree with digests."""
    return f"select href, {d.sha256('cast(min(position) as string)')} as digest from links where page_id % 3 <> 1 group by href"


@view("review_pages", "items")
def _(d):
    """Pages picked for review."""
    return "select distinct doc_id, page from items where role = 'section_header' and page % 3 = 1"


@view("requested_pages", "items")
def _(d):
    """Pages that a smoke run asks for."""
    return "select distinct doc_id, page from items where seq % 8 = 0"


@view("produced_pages", "items")
def _(d):
    """Pages that it has made."""
    return "select distinct doc_id, page from items where page % 5 <> 4"


@view("allowed_hosts")
def _(d):
    """Hosts that may be read from."""
    return "select * from (values ('www.example.com'), ('example.com'), ('docs.example.com')) v(host)"


@view("stage_digests", "attempts")
def _(d):
    """Stages with their digest and the one that they name as upstream; some name another."""
    at = "cast(transaction_id as string) || ':' || cast({0} as string)"
    return f"select transaction_id, sequence, {d.sha256(at.format('sequence'))} as sha, {d.sha256(at.format('case when sequence % 5 = 0 then sequence else sequence - 1 end'))} as upstream from attempts"


@view("toc_titles", "items")
def _(d):
    """Items with their text, of which some are titles of contents."""
    return "select doc_id, seq, page, role, layer, case when seq % 9 = 0 then 'Table of Contents' when seq % 9 = 1 then 'TABLE OF CONTENTS (Continued)' else line end as title from items"


@view("unavailable_sources", "candidates")
def _(d):
    """Sources declared unavailable."""
    return "select source_id from candidates where terminal_state <> 'complete' and source_id % 2 = 0"


@view("element_lines", "items")
def _(d):
    """Lines of a document's elements, some of which occur once more."""
    return "select line from items union all select line from items where layer = 'furniture' and doc_id % 2 = 0"


@view("verified_candidates", "candidates")
def _(d):
    """Complete candidates whose product verifies, with the source that they were made from."""
    return "select candidate_id, source_id % 100 + 1 as of_source from candidates where terminal_state = 'complete' and source_id % 3 = 0"


@view("kept_items", "items")
def _(d):
    """Items with the ordinal that a record states; some lack the one before."""
    return "select doc_id, seq, seq as ordinal from items where not (doc_id % 4 = 1 and seq = 2)"


@view("measurements", "documents")
def _(d):
    """Costs by source at growing sizes."""
    return "select source as series, cast(doc_id % 16 as bigint) as size_, sum(n_chars) as cost from documents group by source, doc_id % 16"


@view("family_members", "tables")
def _(d):
    """Families of tables as recorded: one table in 101 is in two, one in 97 in none."""
    return "select table_id, cast(floor(page / 2) as bigint) as family_id from tables where table_id % 97 <> 5 union all select table_id, -1 from tables where table_id % 101 = 0"


@view("placed_cells", "cells")
def _(d):
    """Cells by the places that they cover; some cover a second one."""
    return "select table_id, r, c from cells union all select table_id, r, c + 1 from cells where c = 1 and r % 50 = 7 and table_id % 3 = 0"


@view("page_mappings", "page_features")
def _(d):
    """Records mapped of each page and the reason stated for none."""
    return "select doc_id, page, regions as mapped, case when regions = 0 and page % 4 <> 0 then 'no_region' end as reason from page_features"


@view("canonical_texts", "items")
def _(d):
    """Native and canonical text of items."""
    return "select doc_id, seq, line as native_text, case when (doc_id + seq) % 997 = 5 then upper(line) else trim(replace(line, '  ', ' ')) end as canonical_text from items"


@view("page_contents", "items")
def _(d):
    """Lists of contents of pages; some lack an item or have one of another page."""
    return "select doc_id, case when (doc_id + seq) % 301 = 7 then page + 1 else page end as page, seq from items where (doc_id + seq) % 61 <> 60"


@view("lineage", "items")
def _(d):
    """Items that the lineage names."""
    return "select doc_id, seq from items where (doc_id + seq) % 41 <> 3"


@view("recorded_links", "mention_status")
def _(d):
    """Statuses as recorded; some are wrong."""
    return "select doc_id, seq, span_start, case when (doc_id + seq) % 53 = 1 then 'resolved' when candidates = 1 then 'resolved' when candidates > 1 then 'ambiguous' else 'unresolved' end as status from mention_status"


@view("recorded_table_links", "key_matches")
def _(d):
    """Table targets as recorded, whatever their distance; some are not there."""
    return "select doc_id, seq, span_start, page, case when (doc_id + seq) % 59 = 2 then 'tab-none' else target_id end as target_id from key_matches where mention_class = 'table'"


@view("recorded_parents", "heading_parents")
def _(d):
    """Parents as recorded; some are lost or moved."""
    return "select doc_id, seq, case when (doc_id + seq) % 43 = 4 then null else parent_seq end as parent_seq from heading_parents where (doc_id + seq) % 89 <> 5"


@view("recorded_scopes", "regimes")
def _(d):
    """Scopes as recorded; some run on into the next."""
    return "select doc_id, start_seq, case when regime_no % 9 = 2 then end_seq + 3 else end_seq end as end_seq from regimes"


@view("recorded_labels", "scl18_page_label_resolution")
def _(d):
    """Label resolutions as recorded; some are wrong."""
    return "select doc_id, page, case when (doc_id + page) % 31 = 3 then 'explicit' else resolution end as resolution from scl18_page_label_resolution"


@view("recorded_counts", "candidates")
def _(d):
    """Outcome counts as recorded; one is off."""
    return "select terminal_state, case when terminal_state = 'complete' then count(*) + 1 else count(*) end as n from candidates group by terminal_state"


@view("stage_summary", "tables")
def _(d):
    """Tables of pages as a stage summed them up."""
    return "select page, max(page_table_index) - case when page % 13 = 6 then 1 else 0 end as n_tables from tables where page % 17 <> 3 group by page"


@view("converted_pages", "items")
def _(d):
    """Pages that a conversion gave; some documents lack one."""
    return "select distinct doc_id, page from items where doc_id % 10 <> 3 or page <> 2"


@view("envelopes", "attempts")
def _(d):
    """Stages with the completion that they refer to; some have lost it."""
    return "select transaction_id, sequence, state, case when state in ('complete', 'complete_with_warnings') and sequence % 17 <> 4 then 'cmp-' || cast(sequence as string) end as completion from attempts"


@view("recorded_ids", "scl14_record_ids")
def _(d):
    """Ids as recorded; some are malformed or repeated."""
    return "select case when (doc_id + seq) % 211 = 9 then upper(id) when (doc_id + seq) % 199 = 8 then 'exv1-0-blk-000001' else id end as id from scl14_record_ids"


@view("accepted_digests", "agg25_semantic_digest")
def _(d):
    """Digests as accepted; some documents have changed since."""
    return "select doc_id, case when doc_id % 10 = 3 then 'x' else digest end as digest from agg25_semantic_digest"


@view("stored_identities", "accounting")
def _(d):
    """Candidate ids as stored; some have been tampered with."""
    return f"select source_id, case when source_id % 9 = 4 then 'tampered' else {d.sha256(chr(39) + 'cand:' + chr(39) + ' || cast(source_id as string)')} end as stored from accounting"


@view("section_tree", "tree")
def _(d):
    """The tree with two sections that are each other's parents, and one below them."""
    return "select id, parent_id, label from tree union all select -1, -2, 'cycle' union all select -2, -1, 'cycle' union all select -3, -2, 'cycle'"


@view("region_pairs", "boxes")
def _(d):
    """Odd parts of a record as regions, even parts as tables."""
    return "select cast(box_id as bigint) as page, cast(row_number() over (partition by box_id order by part_no, l, b, r, t) as bigint) as id, part_no % 2 = 1 as is_region, l, b, r, t from boxes"


@view("family_tables", "tables")
def _(d):
    """Tables of documents."""
    return "select cast(floor(page / 25) as bigint) as doc_id, cast(table_id as bigint) as table_id, page, page_table_index from tables"


@view("family_edges", "family_tables")
def _(d):
    """Evidence that tables go on in others, by kind: continuation before footer run before equal header."""
    return "select doc_id, table_id as a, table_id + 1 as b, case cast(table_id % 3 as int) when 0 then 'continuation' when 1 then 'footer_run' else 'exact_header' end as evidence from family_tables"


@view("contents_features", "items")
def _(d):
    """Items with boxes, of which some headings open contents; what stands on the pages around reads as rows: markers of their own, titles, leaders and pages, or all in one."""
    text = "case when role = 'section_header' and seq % 9 = 0 then 'Table of Contents' when role = 'section_header' and seq % 9 = 1 then 'TABLE OF CONTENTS (Continued)' when role = 'section_header' then ntext"
    text += " when (doc_id + page) % 3 = 0 then ntext when seq % 4 = 0 then cast(page as string) || '.' || cast(seq % 7 + 1 as string) when seq % 4 = 1 then line when seq % 4 = 2 then '.....' else cast(page as string) end"
    return f"select doc_id, seq, page, role, layer, {text} as text, left_pt as l, left_pt + 20 as r, cast(700 - 80 * (seq % 8) as double) as b from items"


@view("contents_outline", "heading_parents", "contents_features")
def _(d):
    """Outlines of some documents: their headings in order, with depth, parent, title and page."""
    return "select h.doc_id, h.seq as position, h.level as depth, h.parent_seq as parent, lower(trim(f.text)) as title, f.page from heading_parents h join contents_features f on f.doc_id = h.doc_id and f.seq = h.seq where h.doc_id % 3 = 0"


@view("printed_pages", "items")
def _(d):
    """Printed labels of pages: two Roman ones in some documents, then numbers."""
    return "select distinct doc_id, page, case when doc_id % 2 = 1 then cast(page as string) when page = 1 then 'i' when page = 2 then 'ii' else cast(page - 2 as string) end as label from items"


@view("record_nodes", "items")
def _(d):
    """Records of documents: a group for each page, and items as texts, tables or pictures; some texts have no valid place, some tables are covered by others."""
    kind = "case seq % 8 when 2 then '#/tables/' when 4 then '#/pictures/' else '#/texts/' end"
    return f"""select doc_id, {kind} || cast(seq as string) as pointer, layer, case when seq % 8 = 2 then (doc_id + seq) % 3 end as tables, seq % 8 = 2 and (doc_id + seq) % 11 = 5 as covered, seq % 8 in (0, 1) and (doc_id + seq) % 41 = 7 as unplaced from items
      union all select distinct doc_id, '#/groups/' || cast(page as string), 'body', cast(null as bigint), false, false from items"""


@view("record_edges", "items")
def _(d):
    """What holds what: the body its pages, a page its items, a table the text after it, a picture the caption after it and the text behind; some documents hold a text twice, some a page that holds itself."""
    text = "'#/texts/' || cast(seq as string)"
    group = "'#/groups/' || cast(page as string)"
    return f"""select distinct doc_id, '#/body' as parent, page as position, {group} as child, false as caption from items
      union all select doc_id, case seq % 8 when 3 then '#/tables/' || cast(seq - 1 as string) when 5 then '#/pictures/' || cast(seq - 1 as string) when 6 then '#/pictures/' || cast(seq - 2 as string) else {group} end, seq,
        case seq % 8 when 2 then '#/tables/' || cast(seq as string) when 4 then '#/pictures/' || cast(seq as string) else {text} end, seq % 8 = 5 from items
      union all select doc_id, {group}, seq + 1000, {text}, false from items where seq = 0 and doc_id % 17 = 3
      union all select doc_id, {group}, seq + 1000, {group}, false from items where seq = 1 and doc_id % 19 = 4"""


@view("record_items", "items")
def _(d):
    """Records by kind: an item in a picture that is no caption is a figure."""
    return "select doc_id, seq, layer, case when in_picture and role <> 'caption' then 'figure' else 'text' end as record_type from items"
