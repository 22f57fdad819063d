"""Hierarchy of documents over corrected headings: one pass in reading order with a stack of open headings for every open numbering scope."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.executors import ship
from folioforge.plans.catalog import operator, view

HIERARCHY = "doc_id bigint, seq bigint, kind string, owner_seq bigint, scope_start bigint, epoch bigint, missing_levels bigint, reason string"
COLUMNS = [c.split()[0] for c in HIERARCHY.split(", ")]
ROOT_LEVEL = 1  # fixed value: level at which numbering begins in a document


@dataclass
class Scope:
    """An open scope (the document has neither start nor end): how often it was cleared, and its open headings as (level, seq), levels rising."""

    start: int | None = None
    end: int | None = None
    root_level: int = ROOT_LEVEL
    epoch: int = 0
    headings: list[tuple[int, int]] = field(default_factory=list)


class Sweep:
    """One document. What is kept is as large as scopes are nested and headings are deep, however long the document is."""

    def __init__(self):
        self.open = [Scope()]
        self.last: int | None = None

    def close(self, seq: int) -> None:
        """Scopes that end before the item close; the scope around each begins anew."""
        while len(self.open) > 1 and self.open[-1].end <= seq:
            self.open.pop()
            self.open[-1].epoch += 1
            self.open[-1].headings.clear()

    def scope(self, start: int, end: int | None, root_level: int | None) -> tuple | None:
        """A scope opens; a row if it cannot."""
        self.close(start)
        around = self.open[-1]
        if end is None or end <= start:
            reason = "scope without items"
        elif around.end is not None and end > around.end:
            reason = "scopes overlap"
        elif (start, end) == (around.start, around.end):
            reason = "scope given twice"
        else:
            self.open.append(Scope(start, end, ROOT_LEVEL if root_level is None else root_level))
            return None
        return (start, "violation", None, around.start, around.epoch, None, reason)

    def item(self, seq: int, role: str | None, level: int | None) -> tuple:
        self.close(seq)
        here = self.open[-1]
        reason = "decided twice" if seq == self.last else "heading without level" if role == "heading" and level is None else None if role in ("heading", "content", "excluded") else "unknown role"
        self.last = seq
        if reason:
            return (seq, "violation", None, here.start, here.epoch, None, reason)
        if role == "excluded":
            return (seq, role, None, here.start, here.epoch, None, None)
        if role == "heading":
            while here.headings and here.headings[-1][0] >= level:
                here.headings.pop()
        above = here.headings[-1] if here.headings else None
        owner = above[1] if above else None
        if role == "content":
            return (seq, "member" if above else "unassigned", owner, here.start, here.epoch, None, None)
        here.headings.append((level, seq))
        missing = level - above[0] - 1 if above else level - here.root_level
        return (seq, "edge" if above else "root", owner, here.start, here.epoch, max(0, missing), None)


def decided(cascade: DataFrame) -> DataFrame:
    """Decisions of the cascade for ``project``. An item that takes part in several contents regions or transfers comes more than once; what is decided alike is one decision."""
    return cascade.select("doc_id", "seq", "role", F.col("corrected_level").alias("level")).distinct()


def project(decisions: DataFrame, scopes: DataFrame, parts: int | None = None) -> DataFrame:
    """Roots, edges, members of sections and content without one, over corrected levels.

    ``decisions``: doc_id, seq, role (heading, content, excluded), level. ``scopes``: doc_id, s, e (the first item after it),
    root_level; they nest, and the document is the scope around all. A heading's parent is the nearest earlier one of a
    smaller level that is open in its own scope; content belongs to the last open heading of its scope. Where a scope ends
    the one around it is cleared (``epoch`` counts that). ``missing_levels``: levels that an edge skips, or that a root lies
    below the first level of its scope. Kinds: root, edge, member, unassigned, excluded, and violation with a reason: a
    heading without level, an unknown role, an item decided again (its first decision by role and level counts), an item or
    scope without place, and scopes that overlap, hold nothing or are given twice. Rows without a document are left out.

    Rows of a document are dealt to one task and sorted there; the task reads them in batches and keeps only open scopes.
    ``parts``: in how many parts they are dealt, if not in the session's.
    """
    ship(decisions.sparkSession)
    big = lambda name: F.col(name).cast("bigint").alias(name)
    rows = decisions.select(big("doc_id"), big("seq"), F.lit(1).alias("what"), F.lit(None).cast("bigint").alias("until"), "role", big("level"))
    rows = rows.unionByName(scopes.select(big("doc_id"), F.col("s").cast("bigint").alias("seq"), F.lit(0).alias("what"), F.col("e").cast("bigint").alias("until"), F.lit(None).cast("string").alias("role"), F.col("root_level").cast("bigint").alias("level")))
    rows = rows.where("doc_id is not null").repartition(*([parts] if parts else []), "doc_id").sortWithinPartitions("doc_id", "seq", "what", F.desc_nulls_last("until"), "role", "level")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, sweep = None, Sweep()
        for batch in batches:
            found = []
            columns = (batch[c].astype("Int64").astype(object).where(batch[c].notna(), None) for c in ("doc_id", "seq", "what", "until", "level"))
            for d, seq, what, until, level, role in zip(*columns, batch.role, strict=True):
                if d != doc:
                    doc, sweep = d, Sweep()
                row = (None, "violation", None, None, None, None, "without place") if seq is None else sweep.item(seq, role, level) if what else sweep.scope(seq, until, level)
                if row:
                    found.append((d, *row))
            out = pd.DataFrame(found, columns=COLUMNS)
            yield out.astype({c: "Int64" for c in COLUMNS if c not in ("kind", "reason")})

    return rows.mapInPandas(run, HIERARCHY)


@view("scope_tree", "scopes")
def _(d):
    """Scopes with the smallest scope around each; -1 is the document."""
    inner = d.row("b.s", "-b.e")
    return f"""select a.doc_id, a.s, a.e, coalesce(max_by(b.s, {inner}), -1) as around_s, coalesce(max_by(b.e, {inner}), -1) as around_e from scopes a
      left join scopes b on b.doc_id = a.doc_id and b.s <= a.s and b.e >= a.e and (b.s < a.s or b.e > a.e) group by a.doc_id, a.s, a.e"""


@view("scoped_decisions", "grf12_rule_cascade", "scopes", "scope_tree")
def _(d):
    """Decisions with their innermost scope and how many scopes directly in it have ended."""
    inner = d.row("s.s", "-s.e")
    return f"""select x.doc_id, x.seq, x.role, x.level, x.s, x.e, count(t.s) as epoch from (select c.doc_id, c.seq, c.role, c.corrected_level as level, coalesce(max_by(s.s, {inner}), -1) as s, coalesce(max_by(s.e, {inner}), -1) as e
        from grf12_rule_cascade c left join scopes s on s.doc_id = c.doc_id and c.seq >= s.s and c.seq < s.e group by c.doc_id, c.seq, c.role, c.corrected_level) x
      left join scope_tree t on t.doc_id = x.doc_id and t.around_s = x.s and t.around_e = x.e and t.e <= x.seq group by x.doc_id, x.seq, x.role, x.level, x.s, x.e"""


@view("corrected_hierarchy", "scoped_decisions")
def _(d):
    """The same rows by joins: the latest earlier heading of the scope and epoch, for a heading one of smaller level. Queries bind the pass under this name."""
    return f"""select x.doc_id, x.seq, case x.role when 'heading' then case when count(h.seq) = 0 then 'root' else 'edge' end when 'content' then case when count(h.seq) = 0 then 'unassigned' else 'member' end else x.role end as kind,
        max(h.seq) as owner_seq, nullif(x.s, -1) as scope_start, x.epoch, case when x.role = 'heading' then greatest(0, x.level - coalesce(max_by(h.level, h.seq) + 1, {ROOT_LEVEL})) end as missing_levels, cast(null as string) as reason
      from scoped_decisions x left join scoped_decisions h on h.doc_id = x.doc_id and h.s = x.s and h.e = x.e and h.epoch = x.epoch and h.role = 'heading' and h.seq < x.seq and (x.role = 'content' or x.role = 'heading' and h.level < x.level)
      group by x.doc_id, x.seq, x.role, x.level, x.s, x.e, x.epoch"""


@operator("win04_corrected_hierarchy", "corrected_hierarchy")
def _(d):
    """Place of every item in the hierarchy over corrected levels."""
    return "select doc_id, seq, kind, owner_seq, scope_start, epoch, missing_levels, reason from corrected_hierarchy"


@operator("win06_sparse_corrected", "corrected_hierarchy")
def _(d):
    """Warnings of depth over corrected levels: edges that skip levels, roots below their scope's first level."""
    return "select doc_id, seq, kind, owner_seq, missing_levels from corrected_hierarchy where missing_levels > 0"


@view("placements", "record_items", "corrected_hierarchy", "toc_regions")
def _(d):
    """Records with their one placement and the section that owns them (null: the root of the body or of the furniture). Tables and figures that no decision places go to the latest heading before them."""
    before = d.last("heading", "partition by doc_id order by seq rows between unbounded preceding and current row")
    kind = """case when layer = 'furniture' then 'furniture' when heading is not null then 'heading_owner' when in_contents then 'toc_content' when kind = 'unassigned' then 'pre_root' when kind = 'member' then 'direct_body'
      when record_type in ('table', 'figure') then 'inherited_nontext' else 'no_placement' end"""
    return f"""select doc_id, seq, placement, case placement when 'heading_owner' then seq when 'direct_body' then owner_seq when 'inherited_nontext' then before end as section_seq, case when placement = 'heading_owner' then owner_seq end as parent_seq
      from (select *, {kind} as placement, {before} as before from (select i.doc_id, i.seq, i.layer, i.record_type, h.kind, h.owner_seq, case when h.kind in ('root', 'edge') then i.seq end as heading, r.doc_id is not null as in_contents
        from record_items i left join (select * from corrected_hierarchy where kind <> 'violation') h on h.doc_id = i.doc_id and h.seq = i.seq left join toc_regions r on r.doc_id = i.doc_id and i.seq between r.start_seq and r.end_seq))"""


@operator("grf13_section_placement", "placements")
def _(d):
    """Placement of records: furniture, heading_owner, toc_content, pre_root, direct_body, inherited_nontext; no_placement is a violation."""
    return "select doc_id, seq, placement, section_seq from placements"


@operator("grf14_section_children", "placements")
def _(d):
    """Direct records and child sections of every section and of the roots in document order; a section's heading comes first."""
    return f"""select doc_id, owner, section_seq, {d.listagg("kind || ':' || cast(seq as string)", 'seq, kind')} as children from (
        select doc_id, case when placement = 'furniture' then 'furniture' when section_seq is null then 'body' else 'section' end as owner, section_seq, seq, 'record' as kind from placements where placement <> 'no_placement'
        union all select doc_id, case when parent_seq is null then 'body' else 'section' end, parent_seq, seq, 'section' from placements where placement = 'heading_owner') group by doc_id, owner, section_seq"""
