"""Orders as ranks (a table has no order of its own), top-k, and set operations."""

from __future__ import annotations

from folioforge.plans.catalog import operator


def ranked(columns: str, relation: str, order: str) -> str:
    return f"select {columns}, cast(row_number() over (order by {order}) as bigint) as position from {relation}"


@operator("srt01_visual_order", "boxes")
def _(d):
    """Top first, then left, then taller: rank on the page."""
    return "select page, box_id, part_no, cast(row_number() over (partition by page order by t desc, l, b desc, box_id, part_no) as bigint) as position from boxes where page_known"


@operator("srt02_target_index_order", "target_index")
def _(d):
    """Rank of targets of a document by key, type, page and id."""
    return "select doc_id, target_id, lookup_key, cast(row_number() over (partition by doc_id order by lookup_key, target_type, page, target_id) as bigint) as position from target_index"


@operator("srt03_candidate_order", "mention_candidates")
def _(d):
    """Rank of a reference's targets: type, page (missing last), id."""
    return """select doc_id, seq, span_start, target_id, cast(row_number() over (partition by doc_id, seq, span_start order by case target_type when 'section' then 0 when 'table' then 1 else 2 end, coalesce(target_page, 1000000000), target_id) as bigint) as position from mention_candidates"""


@operator("srt04_alias_order", "aliases")
def _(d):
    """Rank of aliases by kind, targets and spelling."""
    return "select doc_id, alias_kind, normalized_alias, cast(row_number() over (partition by doc_id order by alias_kind, targets, normalized_alias) as bigint) as position from aliases"


@operator("srt05_warning_order", "win06_sparse_depth")
def _(d):
    """Rank of warnings, those without a place first."""
    return "select doc_id, seq, cast(row_number() over (partition by doc_id order by coalesce(case when missing_levels > 1 then seq end, -1), seq) as bigint) as position from win06_sparse_depth"


@operator("srt07_footer_owner", "boxes")
def _(d):
    """Owner of a page's footer: lowest, then rightmost; combined before it is shuffled."""
    order = d.row("b", "-r", "box_id", "part_no")
    return f"select page, min_by(box_id, {order}) as box_id, min_by(part_no, {order}) as part_no from boxes where page_known group by page"


@operator("srt08_page_spread", "sources")
def _(d):
    """First three, middle four and last three pages; all of ten or fewer."""
    pages = d.series("sources", "page", "1", "pages")
    return f"select source_id, page from {pages} where pages <= 10 or page <= 3 or page > pages - 3 or (page > floor(pages / 2) - 2 and page <= floor(pages / 2) + 2)"


@operator("srt09_largest_documents", "documents")
def _(d):
    """The twenty largest documents."""
    return "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 20"


RANK_BLOCK = 65_536  # ids of which one task numbers the families


@operator("srt10_family_order", "headers")
def _(d):
    """Members of a family in order, families by their first member."""
    if d.name == "spark":  # families are numbered within blocks of ids, which begin where those before end, so that no task ranks them all
        named = d.dealt("(select header, table_id from headers)", "header")
        placed = d.dealt("(select p.first_id, b.before + p.place as family_no from places p join blocks b on b.block = p.block)", "first_id")
        return f"""select * from (with firsts as (select *, min(table_id) over (partition by header) as first_id, row_number() over (partition by header order by table_id) as member from {named}),
      places as (select first_id, first_id div {RANK_BLOCK} as block, cast(row_number() over (partition by first_id div {RANK_BLOCK} order by first_id) as bigint) as place from firsts where member = 1),
      blocks as (select block, sum(n) over (order by block rows between unbounded preceding and current row) - n as before from (select block, count(*) as n from places group by block))
      select f.table_id, p.family_no, cast(f.member as bigint) as member_no from {d.dealt('firsts', 'first_id')} f join {placed} p on p.first_id = f.first_id)"""
    return "select table_id, cast(dense_rank() over (order by first_id) as bigint) as family_no, cast(row_number() over (partition by header order by table_id) as bigint) as member_no from (select table_id, header, min(table_id) over (partition by header) as first_id from headers)"


@operator("set01_expected_discovered", "selection", "manifest_sources")
def _(d):
    """Identifiers expected but not found, and found but not expected."""
    a, b = "select source_id from selection", "select source_id from manifest_sources"
    return f"select source_id, 'missing' as side from ({a} except {b}) union all select source_id, 'unexpected' from ({b} except {a})"


@operator("set02_exact_membership", "sources", "roles")
def _(d):
    """Violations of exact membership: roles outside the set, curator sources other than one by page count."""
    return "select source_id, 'unknown_role' as violation from sources where role not in (select role from roles) union all select source_id, 'second_curator' from sources where role = 'curator_only_response_source' and source_id > (select min(source_id) from sources where role = 'curator_only_response_source')"


@operator("set03_paths", "tree_a", "tree_b")
def _(d):
    """Paths by side: missing, extra, shared."""
    a, b = "select href from tree_a", "select href from tree_b"
    return f"select href, 'missing' as side from ({a} except {b}) union all select href, 'extra' from ({b} except {a}) union all select href, 'shared' from ({a} intersect {b})"


@operator("set04_declared_sources", "candidates", "unavailable_sources")
def _(d):
    """Declared sources that are neither eligible nor unavailable, or both."""
    eligible, unavailable = "select source_id from candidates where terminal_state <> 'failed_terminal'", "select source_id from unavailable_sources"
    return f"select source_id, 'neither' as problem from (select source_id from candidates except ({eligible}) except ({unavailable})) union all select source_id, 'both' from ({eligible} intersect {unavailable})"


@operator("set05_multiset_union", "items", "element_lines")
def _(d):
    """Body and furniture together against all elements as multisets: lines whose counts differ."""
    return "select line, sum(n) as difference from (select line, count(*) as n from element_lines group by line union all select line, -count(*) from items where layer in ('body', 'furniture') group by line) group by line having sum(n) <> 0"


@operator("set06_anomaly_concatenation", "anomalies", "win06_sparse_depth")
def _(d):
    """Anomaly streams end to end, in their order."""
    return "select 0 as stream, category, record_id from anomalies union all select 1, 'sparse_depth', doc_id * 4294967296 + seq from win06_sparse_depth"


@operator("set07_semantic_preservation", "baseline_rows", "candidate_rows")
def _(d):
    """Records that differ beyond the fields that may change."""
    return "select source_id, title from baseline_rows except select source_id, title from candidate_rows"


@operator("set08_duplicates", "lines")
def _(d):
    """Lines that occur more than once in the corpus."""
    return "select line, count(*) as copies from lines where line <> '' group by line having count(*) > 1"
