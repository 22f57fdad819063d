"""Persisted outputs of the parsing stages as relations, and records bound to them."""

from __future__ import annotations

from folioforge.plans.catalog import operator


@operator("src10_page_features", "page_features")
def _(d):
    """Measured features of every page."""
    return "select doc_id, page, chars, nonspace, digits, nonempty_lines, regions from page_features"


@operator("src11_outline_nodes", "outline")
def _(d):
    """Outline nodes with ids in reading order and their parent: the latest earlier node of smaller depth."""
    w = "partition by doc_id order by seq rows between unbounded preceding and 1 preceding"
    lasts = ", ".join(f"{d.last(f'case when depth = {k} then seq end', w)} as last_{k}" for k in (1, 2))
    return f"select doc_id, seq as outline_seq, page, depth, case depth when 1 then null when 2 then last_1 else greatest(coalesce(last_1, -1), coalesce(last_2, -1)) end as parent_seq from (select *, {lasts} from outline)"


@operator("src12_native_heading_text", "headings", "items")
def _(d):
    """Native text on the page of each heading."""
    return "select h.doc_id, h.seq, count(*) as lines, cast(sum(length(i.line)) as bigint) as chars from headings h join items i on i.doc_id = h.doc_id and i.page = h.page group by h.doc_id, h.seq"


@operator("src13_document_views", "items", "prj02_level_overlay")
def _(d):
    """Base view and heading overlay of a document's items."""
    return "select i.doc_id, i.seq, i.role, o.level as overlay_level from items i left join prj02_level_overlay o on o.doc_id = i.doc_id and o.ref = i.seq"


@operator("src14_table_bundle", "tables", "grid", "headers")
def _(d):
    """Table records with their cells and headers."""
    return "select t.table_id, t.page, t.page_table_index, coalesce(g.n, 0) as rows, h.header from tables t left join (select table_id, count(*) as n from grid group by table_id) g on g.table_id = t.table_id left join headers h on h.table_id = t.table_id"


@operator("prj26_support_payloads", "items", "headings", "jn26_producer_bridge")
def _(d):
    """Preservation, bridge, correspondence and control facts of a document."""
    return """select doc_id, 'preservation' as payload, count(*) as n from items group by doc_id union all select doc_id, 'bridge', count(*) from jn26_producer_bridge where block_id is not null group by doc_id
      union all select doc_id, 'correspondence', count(*) from headings group by doc_id union all select doc_id, 'control', count(distinct page) from items group by doc_id"""


@operator("agg25_semantic_digest", "items")
def _(d):
    """Digest of a document's content rows with its own id left out."""
    row = d.sha256("role || ':' || coalesce(cast(level as string), '') || ':' || line")
    return f"select doc_id, {d.sha256(d.listagg(row, 'seq'))} as digest from items group by doc_id"


@operator("lif24_config_binding", "attempts")
def _(d):
    """Configuration of the next stage bound to the completion just reached."""
    return f"select transaction_id, sequence, 'cfg-' || substr({d.sha256('''cast(transaction_id as string) || '@' || cast(sequence as string)''')}, 1, 16) as config_id from attempts where state in ('complete', 'complete_with_warnings')"


@operator("val19_inventory_closure", "tree_a", "tree_b")
def _(d):
    """Files that an inventory and a folder do not have in common with equal digests."""
    return "select coalesce(a.href, b.href) as path, case when b.href is null then 'missing' when a.href is null then 'extra' else 'changed' end as violation from tree_a a full outer join tree_b b on a.href = b.href where a.digest is distinct from b.digest"


@operator("val20_source_release", "sources", "roles")
def _(d):
    """Sources of a release whose pages, role or title break its rules."""
    return "select source_id, case when pages < 1 then 'pages' when title is null then 'title' else 'role' end as violation from sources where pages < 1 or title is null or role not in (select role from roles where role <> 'recovery_qa_duplicate')"


@operator("val22_scoped_acceptance", "agg25_semantic_digest", "accepted_digests")
def _(d):
    """Documents whose observed digest differs from the accepted one, or that only one side has."""
    return "select coalesce(o.doc_id, e.doc_id) as doc_id from agg25_semantic_digest o full outer join accepted_digests e on e.doc_id = o.doc_id where e.digest is distinct from o.digest"


@operator("val23_production_identity", "stored_identities")
def _(d):
    """Candidates whose id is not the digest of their closed fields."""
    x = "'cand:' || cast(source_id as string)"
    return f"select source_id from stored_identities where stored <> {d.sha256(x)}"
