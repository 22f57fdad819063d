"""Hierarchy over corrected levels on documents made by hand, and placements in it."""

from __future__ import annotations

import random

from folioforge.operators.hierarchy import Sweep, decided, project
from folioforge.plans.catalog import apply

H = "heading"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, seq bigint, role string, level bigint")


def scoped(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, s bigint, e bigint, root_level bigint")


def found(df):
    return sorted(((r.seq, r.kind, r.owner_seq, r.missing_levels) for r in df.collect() if r.kind != "violation"), key=str)


def place(spark, rows, scopes=()):
    return found(project(frame(spark, [(1, *x) for x in rows]), scoped(spark, [(1, *x) for x in scopes])))


def test_levels_close_equal_and_deeper_headings(spark):
    got = place(spark, [(0, "content", None), (1, H, 1), (2, "content", None), (3, H, 2), (4, H, 3), (5, "content", None), (6, H, 2), (7, "excluded", None), (8, H, 1)])
    assert got == [(0, "unassigned", None, None), (1, "root", None, 0), (2, "member", 1, None), (3, "edge", 1, 0), (4, "edge", 3, 0), (5, "member", 4, None), (6, "edge", 1, 0), (7, "excluded", None, None), (8, "root", None, 0)]


def test_skipped_levels_are_counted_against_parent_or_scope(spark):
    assert place(spark, [(0, H, 3), (1, H, 7), (2, H, 5)]) == [(0, "root", None, 2), (1, "edge", 0, 3), (2, "edge", 0, 1)]
    assert place(spark, [(4, H, 3)], [(4, 9, 3)]) == [(4, "root", None, 0)]
    assert place(spark, [(4, H, 1)], [(4, 9, 3)]) == [(4, "root", None, 0)]


def test_a_nested_scope_has_its_own_stack_and_its_end_clears_the_one_around(spark):
    got = place(spark, [(0, H, 1), (1, "content", None), (2, "content", None), (3, H, 2), (4, "content", None), (5, H, 2), (6, "content", None)], [(2, 4, 1)])
    # 2 and 3 see nothing of heading 0; when the scope has ended neither does what follows
    assert got == [(0, "root", None, 0), (1, "member", 0, None), (2, "unassigned", None, None), (3, "root", None, 1), (4, "unassigned", None, None), (5, "root", None, 1), (6, "member", 5, None)]


def test_scopes_that_end_together_clear_every_scope_around(spark):
    got = place(spark, [(0, H, 1), (1, H, 1), (2, H, 1), (4, "content", None), (5, H, 2)], [(1, 4, 1), (2, 4, 1)])
    assert got == [(0, "root", None, 0), (1, "root", None, 0), (2, "root", None, 0), (4, "unassigned", None, None), (5, "root", None, 1)]


def test_what_is_wrong_is_reported_and_the_rest_stands(spark):
    rows = [(1, 0, H, 1), (1, 1, H, None), (1, 2, "title", 1), (1, 3, "content", None), (1, 3, "content", None), (1, None, "content", None), (None, 4, H, 1), (2, 0, "content", None)]
    df = project(frame(spark, rows), scoped(spark, [(1, 10, 20, 1), (1, 15, 25, 1), (1, 10, 20, 1), (1, 30, 30, 1), (1, 40, None, 1), (None, 0, 5, 1)]))
    got = df.collect()
    assert sorted((r.doc_id, -1 if r.seq is None else r.seq, r.reason) for r in got if r.kind == "violation") == [
        (1, -1, "without place"), (1, 1, "heading without level"), (1, 2, "unknown role"), (1, 3, "decided twice"), (1, 10, "scope given twice"), (1, 15, "scopes overlap"), (1, 30, "scope without items"), (1, 40, "scope without items"),
    ]
    assert sorted((r.doc_id, r.seq, r.kind) for r in got if r.kind != "violation") == [(1, 0, "root"), (1, 3, "member"), (2, 0, "unassigned")]


def test_empty_tables_and_extra_columns(spark):
    assert project(frame(spark, []), scoped(spark, [])).collect() == []
    one = frame(spark, [(1, 0, H, 1)]).selectExpr("*", "'x' as what", "1 as until", "'y' as kind")
    assert found(project(one, scoped(spark, []).selectExpr("*", "'z' as seq", "1 as role"))) == [(0, "root", None, 0)]


def test_long_documents_are_one_pass_over_many_batches(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("cast(1 as bigint) as doc_id", "id as seq", "case when id % 3 = 0 then 'heading' else 'content' end as role", "case when id % 3 = 0 then id % 4 + 1 end as level")
    got = project(rows, scoped(spark, [])).selectExpr("count(*) as n", "count(distinct seq) as d", "sum(case when kind = 'member' then seq - owner_seq end) as away").first()
    assert (got.n, got.d, got.away) == (n, n, n // 3 * 3)


def test_the_pass_agrees_with_the_definition_by_joins(spark):
    rng = random.Random(5)
    decisions, scopes = [], []
    for doc in range(30):
        spans = {(a - a % w, a - a % w + w) for w in (4, 8, 16) for a in (rng.randrange(48) for _ in range(2))}
        scopes += [(doc, s, e, 1) for s, e in spans]
        for seq in range(50):
            role = rng.choice([H, H, "content", "content", "excluded"])
            decisions.append((doc, seq, role, rng.randint(1, 9) if role == H else None))
    decided, spans = frame(spark, decisions), scoped(spark, scopes)
    joined = apply(spark, "win04_corrected_hierarchy", grf12_rule_cascade=decided.withColumnRenamed("level", "corrected_level"), scopes=spans)
    passed = project(decided, spans)
    columns = joined.columns
    assert sorted(map(str, passed.select(columns).collect())) == sorted(map(str, joined.collect())) and passed.count() == 1500


def test_an_item_decided_alike_twice_is_one_as_in_the_definition(spark):
    cascade = frame(spark, [(1, 0, H, 1), (1, 1, H, 2), (1, 1, H, 2), (1, 2, "content", None), (1, 2, "content", None), (2, 2, "content", None)]).withColumnRenamed("level", "corrected_level")
    joined = apply(spark, "win04_corrected_hierarchy", grf12_rule_cascade=cascade, scopes=scoped(spark, []))
    passed = project(decided(cascade), scoped(spark, []))
    assert sorted(map(str, passed.select(joined.columns).collect())) == sorted(map(str, joined.collect())) and passed.count() == 4


def test_placements_and_children(spark):
    decided = project(frame(spark, [(1, 0, "content", None), (1, 1, "excluded", None), (1, 2, H, 1), (1, 3, "content", None), (1, 4, H, 2), (1, 6, "content", None), (1, 7, H, 1), (1, 8, "excluded", None)]), scoped(spark, []))
    records = spark.createDataFrame([(1, 0, "body", "text"), (1, 1, "body", "text"), (1, 2, "body", "text"), (1, 3, "body", "text"), (1, 4, "body", "text"), (1, 5, "body", "table"), (1, 6, "body", "text"), (1, 7, "body", "text"), (1, 8, "body", "text"), (1, 9, "furniture", "text"), (2, 0, "body", "figure")], "doc_id bigint, seq bigint, layer string, record_type string")
    regions = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, start_seq bigint, end_seq bigint")
    given = dict(record_items=records, corrected_hierarchy=decided, toc_regions=regions)
    got = {(r.doc_id, r.seq): (r.placement, r.section_seq) for r in apply(spark, "grf13_section_placement", **given).collect()}
    assert got == {
        (1, 0): ("pre_root", None), (1, 1): ("toc_content", None), (1, 2): ("heading_owner", 2), (1, 3): ("direct_body", 2), (1, 4): ("heading_owner", 4), (1, 5): ("inherited_nontext", 4), (1, 6): ("direct_body", 4),
        (1, 7): ("heading_owner", 7), (1, 8): ("no_placement", None), (1, 9): ("furniture", None), (2, 0): ("inherited_nontext", None),
    }
    children = {(r.doc_id, r.owner, r.section_seq): r.children for r in apply(spark, "grf14_section_children", **given).collect()}
    assert children == {
        (1, "body", None): "record:0,record:1,section:2,section:7", (1, "section", 2): "record:2,record:3,section:4", (1, "section", 4): "record:4,record:5,record:6",
        (1, "section", 7): "record:7", (1, "furniture", None): "record:9", (2, "body", None): "record:0",
    }


def test_the_state_of_a_document_is_as_large_as_its_depth():
    sweep = Sweep()
    for seq in range(10_000):
        sweep.item(seq, H, seq % 5 + 1)
        assert len(sweep.open[-1].headings) <= 5
