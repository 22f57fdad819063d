"""Operators on rows made by hand: what each rule says, apart from any engine's SQL."""

from __future__ import annotations

import pytest

from folioforge.operators import sequential, trees
from folioforge.plans.catalog import apply

ITEM = "doc_id bigint, seq bigint, page bigint, line string, role string, layer string, level bigint, left_pt double, in_picture boolean, n_regions int, ntext string, mtext string"


def item(seq, text="", role="text", level=None, layer="body", left=72.0, page=1, picture=False, doc=1):
    return (doc, seq, page, text, role, layer, level, left, picture, 1, text, text)


@pytest.fixture
def items(spark):
    return lambda *rows: spark.createDataFrame(list(rows), ITEM)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_every_reference_of_every_class(spark, items):
    text = "See Section 3.2, Section 4 of the Clean Water Act, Table 2-a in Reference 3, Figure 1.1, Appendix B.1 and the Draft EIR for Bay Plan (2019), page iv, Page 3 of 9, Section 15126.2."
    found = apply(spark, "scl07_mention_grammar", items=items(item(0, text)))
    assert rows(found, "mention_class", "lookup_key") == sorted(
        [("section", "3.2"), ("section", "4"), ("table", "table 2-a"), ("figure", "figure 1.1"), ("appendix", "appendix b.1"), ("document", "draft eir for bay plan"), ("printed_page", "iv"), ("printed_page", "3"), ("section", "15126.2")]
    )
    assert all(text[r.span_start : r.span_end] == r.raw_text for r in found.collect())
    # statutory sections, counters of pages and numbers of four digits are no references; of a table elsewhere only the resolution says so
    kept = apply(spark, "scl26_record_references", items=items(item(0, text)), toc_regions=spark.createDataFrame([], "doc_id bigint, start_seq bigint, end_seq bigint"))
    assert {r.ref for r in kept.collect()} == {"sec-3.2", "tab-table 2-a", "page-1"}


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (" Page 3 of 9 ", "page_furniture"), ("page 3 OF 9", "page_furniture"), ("see Page 3 of 9", None), ("Table 2-a", "standalone_target_label"), ("APPENDIX C", "standalone_target_label"), ("Table 2 shows", None),
        ("Smith & Jones, 2019. Title", "bibliography"), ("see Smith, 2019", None), ("it was recorded on May 4 in Book 7 at page 12.", "deed_recordation"), ("it was recorded in Book 7", None),
    ],
)
def test_blocks_that_are_not_searched(spark, items, text, reason):
    assert [r.reason for r in apply(spark, "flt02_block_exclusions", items=items(item(0, text))).collect()] == ([reason] if reason else [])


@pytest.mark.parametrize(
    ("suffix", "disposition"),
    [(" of the Clean Water Act", "statutory"), (" of this Agreement", "local"), (" of the Purchase Agreement", "qualified_external_section"), (" OF the final eir", "qualified_external_section"), (" of the shore", "local"), ("; the Plan", "local")],
)
def test_section_dispositions(spark, items, suffix, disposition):
    assert [r.disposition for r in apply(spark, "flt04_section_dispositions", items=items(item(0, f"see Section 3.2{suffix}"))).collect()] == [disposition]


@pytest.mark.parametrize(("suffix", "external"), [(" in reference 3", True), (" OF Reference 12", True), (" in reference 0", False), (" in references", False), (" below", False)])
def test_external_tables(spark, items, suffix, external):
    assert [r.external for r in apply(spark, "flt07_external_tables", items=items(item(0, f"Table 4{suffix}"))).collect()] == [external]


@pytest.mark.parametrize(
    ("measures", "route"),
    [
        ((0.9, 0.9, 100, 0.03, 0.4, 0), "full_page_numeric"),  # strict
        ((0.9, 0.5, 100, 0.03, 0.4, 0), "full_page_numeric"),  # dense but partly filled
        ((0.9, 0.3, 100, 0.03, 0.4, 0), "no_table_route"),  # too little of the page
        ((0.9, 0.1, 25, 0.006, 0.6, 0), "full_page_numeric"),  # numeric
        ((0.5, 0.9, 100, 0.03, 0.9, 0), "no_table_route"),  # digits alone do not make a table
        ((0.9, 0.9, 10, 0.03, 0.9, 2), "layout_regions"),
    ],
)
def test_page_routes(spark, measures, route):
    df = spark.createDataFrame([(1, 1, *measures)], "doc_id bigint, page bigint, width_fraction double, height_fraction double, nonempty_lines bigint, density double, digit_fraction double, regions bigint")
    assert apply(spark, "flt10_page_route", page_measures=df).first().route == route


@pytest.mark.parametrize(
    ("left", "right", "boundaries", "compatible"),
    [(0.2, 0.8, [0.2, 0.5, 0.8], True), (0.1, 0.7, [0.2, 0.5, 0.8], False), (0.2, 0.8, [0.2, 0.53, 0.8], False), (0.2, 0.8, [0.2, 0.8], False)],
)
def test_edge_geometry_compares_both_edges_and_columns(spark, left, right, boundaries, compatible):
    s = "box_id bigint, part_no int, bottom_fraction double, top_fraction double, left_fraction double, right_fraction double, boundaries array<double>"
    df = spark.createDataFrame([(1, 1, 0.1, 0.5, 0.2, 0.8, [0.2, 0.5, 0.8]), (1, 2, 0.5, 0.9, left, right, boundaries)], s)
    assert apply(spark, "flt20_edge_geometry", table_edges=df).first().compatible is compatible


def test_attempt_lifecycle(spark):
    s = "transaction_id bigint, sequence bigint, state string, raw_status string, source_id bigint"
    ok = [(1, 1, "selected", "PENDING", 1), (1, 2, "running", "STARTED", 1), (1, 3, "failed_terminal", "SUCCESS", 1)]
    bad = [(2, 1, "running", "STARTED", 2), (2, 2, "complete", "FAILURE", 2), (3, 1, "selected", "PENDING", 3), (3, 2, "running", "STARTED", 3), (3, 3, "failed_retryable", None, 3), (3, 4, "selected", "PENDING", 3)]
    df = spark.createDataFrame(ok + bad, s)
    assert rows(apply(spark, "lif01_illegal_transitions", attempts=df), "transaction_id", "sequence", "violation") == [(2, 1, "transition"), (2, 2, "status"), (3, 4, "transition")]
    assert rows(apply(spark, "lif03_next_attempt", attempts=df), "transaction_id", "verdict") == [(1, "refuse_terminal"), (2, "refuse_complete"), (3, "close_then_retry")]
    gaps = spark.createDataFrame([*ok, (4, 1, "selected", "PENDING", 4), (4, 3, "running", "STARTED", 4), (5, 1, "selected", "PENDING", 5), (5, 2, "running", "STARTED", 6)], s)
    assert rows(apply(spark, "lif02_history_gaps", histories=gaps), "transaction_id") == [(4,), (5,)]


def test_local_resolution_in_order(spark):
    m = [(0, "figure", "figure 1", ""), (1, "table", "table 1", " in reference 2"), (2, "table", "table 1", ""), (3, "table", "table 2", ""), (4, "section", "3.2", ""), (5, "section", "9", ""), (6, "appendix", "appendix a", ""), (7, "appendix", "appendix z", ""), (8, "document", "final eir for x y", ""), (9, "document", "draft eir for x y", "")]
    mentions = spark.createDataFrame([(1, 0, n, 1, k, key, suffix) for n, k, key, suffix in m], "doc_id bigint, seq bigint, span_start bigint, page bigint, mention_class string, lookup_key string, suffix string")
    index = [("table 1", "table", 5, "t1"), ("table 2", "table", 40, "t2"), ("3.2 title", "section", 2, "s1"), ("3.2", "section", 9, "s2")]
    targets = spark.createDataFrame([(1, *x) for x in index], "doc_id bigint, lookup_key string, target_type string, page bigint, target_id string")
    family = spark.createDataFrame([(1, 7, "top_level_appendix", "appendix a"), (2, 7, "root_report", "final eir for x y")], "source_id bigint, root_id bigint, role string, alias string")
    got = apply(spark, "lif11_local_resolution", mentions=mentions, target_index=targets, family=family, document_sources=spark.createDataFrame([(1, 7)], "doc_id bigint, root_id bigint"))
    assert rows(got, "span_start", "status", "reason") == [
        (0, "unresolved", "target_type_unavailable"), (1, "unresolved", "qualified_external_table"), (2, "resolved", None), (3, "unresolved", "outside_table_window"), (4, "ambiguous", None),
        (5, "unresolved", "no_local_alias"), (6, "unresolved", "deferred_cross_document"), (7, "unresolved", "no_local_alias"), (8, "unresolved", "deferred_cross_document"), (9, "unresolved", "external_document"),
    ]


def test_numbers_of_headings(spark, items):
    texts = ["1.2.3 Deep", "7. Title", "120. Title", "0. Title", "120 Title", "99 Title", "0 Title", "Article IV Scope", "XI. Title", "B. Title", "I. Title", "• point", "(1) bracket", "Plain"]
    got = apply(spark, "scl05_numbering_grammar", items=items(*(item(k, t) for k, t in enumerate(texts)), item(99, "1. list", role="list_item")))
    assert rows(got, "seq", "kind", "token", "depth") == [
        (0, "decimal", "1.2.3", 3), (1, "decimal", "7", 1), (2, "decimal", "120", 1), (3, "decimal", "0", 1), (4, "none", None, None), (5, "decimal", "99", 1), (6, "none", None, None), (7, "article", "IV", 1), (8, "upper_roman", "XI", 1), (9, "upper_alpha", "B", 1),
        (10, "upper_roman", "I", 1), (11, "bullet", "•", None), (12, "none", None, None), (13, "none", None, None), (99, "none", None, None),
    ]


EVIDENCE = "doc_id bigint, seq bigint, role string, layer string, level bigint, in_picture boolean, outline_state string, outline_level bigint, numbering_kind string, toc_target boolean, toc_level bigint, toc_region boolean, calibrated_level bigint, root_level bigint, previous_level bigint, indented_item bigint, sibling boolean, transfer boolean, transfer_level bigint"


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ({"layer": "furniture"}, ("R01", "excluded", None, "applied")),
        ({"in_picture": True, "role": "caption"}, ("R08", "content", None, "unchanged")),
        ({"numbering_kind": "bullet", "indented_item": 4}, ("R02", "content", None, "applied")),
        ({"numbering_kind": "bullet"}, ("R02", "content", None, "ambiguous")),
        ({"numbering_kind": "bullet", "toc_target": True, "toc_level": 3}, ("R04", "heading", 3, "applied")),
        ({"outline_state": "unique_exact", "outline_level": 2}, ("R03", "heading", 2, "applied")),
        ({"calibrated_level": 3, "previous_level": 2}, ("R05", "heading", 3, "applied")),
        ({"calibrated_level": 4, "previous_level": 2}, ("R05", "content", None, "ambiguous")),
        ({"calibrated_level": 2}, ("R05", "content", None, "ambiguous")),
        ({"sibling": True, "transfer": True, "transfer_level": 2}, ("R06", "content", None, "ambiguous")),
        ({"transfer": True, "transfer_level": 2}, ("R07", "heading", 2, "applied")),
        ({"transfer": True}, ("R07", "content", None, "ambiguous")),
        ({}, ("R08", "heading", 2, "unchanged")),
        ({"role": "text", "level": None}, ("R08", "content", None, "unchanged")),
    ],
)
def test_rule_cascade(spark, changes, expected):
    base = {"doc_id": 1, "seq": 1, "role": "section_header", "layer": "body", "level": 2, "in_picture": False, "outline_state": "absent", "numbering_kind": "none", "toc_target": False, "toc_region": False, "root_level": 1, "sibling": False, "transfer": False}
    row = base | changes
    df = spark.createDataFrame([tuple(row.get(c.split()[0]) for c in EVIDENCE.split(", "))], EVIDENCE)
    r = apply(spark, "grf12_rule_cascade", rule_evidence=df).first()
    assert (r.selected, r.role, r.corrected_level, r.outcome) == expected and r.eligible.split()[0] == expected[0]


def test_levels_are_calibrated_by_the_nearest_anchor(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1, 2, None), (1, 2, 1, 1, 1, 1, 3), (1, 3, 1, 1, 1, 2, None), (1, 4, 1, 2, 1, 2, None)], "doc_id bigint, seq bigint, level bigint, regime_no bigint, root_level bigint, depth bigint, anchor_level bigint")
    assert rows(apply(spark, "win03_calibrated_level", numbered=df), "seq", "calibrated_level") == [(1, 2), (2, 3), (3, 4), (4, 2)]


def test_shallower_headings_and_indented_items(spark, items):
    heads = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 1)], "doc_id bigint, seq bigint, level bigint")
    got = {r.seq: r.next_seq for r in apply(spark, "win09_next_shallower", headings=heads).collect()}
    assert got == {1: 3, 2: 3, 3: 4, 4: None}
    one = items(item(1, level=2, role="section_header"), item(2, role="list_item", left=80.0), item(3, role="list_item", left=90.0), item(4, level=2, role="section_header"), item(5, role="list_item", left=90.0, page=2))
    assert {r.seq: r.item for r in apply(spark, "win17_first_indented_item", items=one).collect()} == {1: 3, 4: None}


def test_tables_follow_the_last_event_before_them(spark):
    tables = spark.createDataFrame([(1, 1, 10, 1), (1, 3, 11, 1), (2, 1, 12, 1)], "doc_id bigint, page bigint, table_id bigint, page_table_index bigint")
    events = spark.createDataFrame([(1, 5, 2), (1, 7, 3), (1, 3, 3)], "doc_id bigint, seq bigint, page bigint")
    assert rows(apply(spark, "jn28_attach_by_page", page_tables=tables, body_events=events), "table_id", "after_seq") == [(10, -1), (11, 7), (12, -1)]


def test_rulings_cover_candidates_together(spark):
    candidates = spark.createDataFrame([(1, 4, 0.0, 0.0, 10.0, 10.0), (1, 5, 0.0, 0.0, 100.0, 10.0), (1, 6, 3.0, 3.0, 3.0, 6.0), (2, 4, 0.0, 0.0, 10.0, 10.0)], "box_id bigint, part_no int, l double, b double, r double, t double")
    ruled = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (1, 0.0, 0.0, 5.0, 5.0), (1, 2.0, 2.0, 7.0, 7.0), (2, 10.0, 0.0, 20.0, 10.0)], "box_id bigint, l double, b double, r double, t double")
    got = apply(spark, "flt14_network_candidates", network_boxes=candidates, ruled_boxes=ruled)
    assert rows(got, "box_id", "part_no", "coverage", "kept") == [(1, 4, 0.41, False), (1, 5, 0.041, True), (1, 6, 0.0, True), (2, 4, 0.0, True)]


def test_children_are_content_and_sections_in_order(spark, items):
    head = dict(role="section_header")
    one = items(item(0), item(1, level=1, **head), item(2), item(3, level=2, **head), item(4), item(5, role="page_footer", layer="furniture"), item(6, level=1, **head))
    got = {r.parent_seq: r.children for r in apply(spark, "grf14_ordered_children", items=one).collect()}
    assert got == {1: "content:1,content:2,section:3", 3: "content:3,content:4", 6: "content:6"}


def test_ends_of_nested_scopes_clear_the_scope_around(spark, items):
    scopes = spark.createDataFrame([(1, 0, 16), (1, 0, 8), (1, 8, 16), (1, 2, 4), (1, 20, 24)], "doc_id bigint, s bigint, e bigint")
    got = apply(spark, "win05_scope_exit_epochs", items=items(*[item(k) for k in range(30)]), scopes=scopes)
    assert rows(got, "around_s", "around_e", "boundary_seq", "ended", "epoch") == [(0, 8, 4, 1, 1), (0, 16, 8, 1, 1), (0, 16, 16, 1, 2)]


def test_trees_by_pointer_doubling(spark):
    from pyspark.sql import functions as F

    chain = [(k, k - 1 if k else None) for k in range(300)]  # deeper than a walk of a hundred levels
    tree = spark.createDataFrame([*chain, (1000, None), (1001, 1000), (1002, 1000), (1003, 1001), (2000, 2001), (2001, 2000), (2002, 2000), (3000, 9999)], "id bigint, parent_id bigint")
    got = {r.id: (r.root, r.depth) for r in trees.path_sums(tree, depth=F.lit(1)).collect()}
    assert all(got[k] == (0, k + 1) for k in range(300)) and got[1003] == (1000, 3)
    assert all(got[k] == (None, None) for k in (2000, 2001, 2002, 3000))
    small = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)], "id bigint, parent_id bigint")
    assert [r.id for r in trees.preorder(small).orderBy("position").collect()] == [1, 2, 4, 5, 3, 6]
    assert {r.id: r.size for r in trees.subtree_sizes(small).collect()} == {1: 6, 2: 3, 3: 2, 4: 1, 5: 1, 6: 1}
    kept = trees.nearest_kept(small, F.col("id").isin(4, 5, 6, 1))
    assert {r.id: r.parent_id for r in kept.collect()} == {4: 1, 5: 1, 6: 1, 1: None}


def test_matching_counts_as_it_collects(spark):
    """Both sides come from one frame, and a count prunes columns."""
    import random

    rng = random.Random(4)
    made = []
    for page in range(20):
        for k in range(rng.randrange(1, 9)):
            x, y = rng.randrange(5), rng.randrange(5)
            made.append((page, k, float(x), float(y), x + 4.0, y + 4.0))
    both = spark.createDataFrame(made, "page bigint, id bigint, l double, b double, r double, t double")
    got = sequential.match_regions(both.where("id % 2 = 1"), both.where("id % 2 = 0"), 0.3)

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return w * h / (32 - w * h) if w > 0 and h > 0 else 0.0

    want = set()
    for page in range(20):
        here = [x for x in made if x[0] == page]
        free = {x[1] for x in here if x[1] % 2 == 0}
        for a in sorted((x for x in here if x[1] % 2), key=lambda x: (-x[5], x[2], -x[3], x[1])):
            best = min(((-iou(a, b), b[1]) for b in here if b[1] in free), default=None)
            if best and -best[0] >= 0.3:
                want.add((page, a[1], best[1]))
                free.discard(best[1])
    assert {(r.page, r.region_id, r.table_id) for r in got.collect()} == want and got.count() == len(want)


def test_a_callers_views_stay(spark, items):
    spark.range(3).createOrReplaceTempView("items")
    assert apply(spark, "flt01_mention_sources", items=items(item(0))).count() == 1
    assert spark.table("items").count() == 3


CELLS = "table_id bigint, r bigint, c int, text string"


def table(spark, *texts):
    return spark.createDataFrame([(1, r, c, x) for r, row in enumerate(texts, 1) for c, x in enumerate(row)], CELLS)


def test_rows_that_cleaning_removes(spark):
    """Counters go wherever they are, file names only before other rows; a column counts if a kept row fills it."""
    cells = table(spark, ("Page 3 OF 12", "", ""), ("extract_v2", "", ""), ("Name", "Count", ""), ("x", "12 of them", ""), ("later_v3", "", ""), ("", "4 of 9", "z"))
    assert rows(apply(spark, "scl11_row_cleanup", cells=cells), "rows_raw", "rows_kept", "footer_rows", "filename_rows", "columns_kept") == [(6, 3, 2, 1, 2)]
    only = table(spark, ("a_v1", "b_v1"), ("c_v1", ""))
    assert rows(apply(spark, "scl11_row_cleanup", cells=only), "rows_kept", "filename_rows") == [(2, 0)]


def test_header_rows(spark):
    """Shares are of filled cells; signs and units are part of numbers; coordinates end a header; empty rows are part of it."""

    def size(*texts):
        return rows(apply(spark, "scl12_header_matrix_rows", cells=table(spark, *texts)), "header_rows")

    assert size(("Name", "Count", ""), ("", "", ""), ("x", "$(1,200.5 %", ""), ("y", "2", "")) == [(2,)]
    assert size(("Name", "", "7", "x"), ("n", "1", "", "")) == [(1,)]
    assert size(("Name", "Key"), ("x", "123456.5_1234567.25_")) == [(1,)]
    assert size(("1", "2"), ("a", "b")) == [] and size(("", ""), ("1", "")) == []
    assert size(*[("a", "b")] * 11) == [(8,)]


def test_headers_are_compared_over_all_columns(spark):
    make = lambda t, name: [(t, 1, 0, "A"), (t, 1, 1, "B"), (t, 1, 2, name), (t, 2, 0, "1"), (t, 2, 1, "2"), (t, 2, 2, "3")]
    cells = spark.createDataFrame([*make(1, "C"), *make(2, "C"), *make(3, "X")], CELLS)
    assert rows(apply(spark, "flt19_header_equality", cells=cells), "first_id", "next_id") == [(1, 2)]


NO_REGIONS = "doc_id bigint, start_seq bigint, end_seq bigint"


def siblings(spark, items, *changed, state="unique_aligned", regions=()):
    base = {0: item(0, "Before", "section_header", 2), 1: item(1, "body text"), 2: item(2, "Sibling"), 3: item(3, "more text"), 4: item(4, "After", "section_header", 2)}
    df = items(*(base | {x[1]: x for x in changed}).values())
    aligned = spark.createDataFrame([(1, k, state) for k in range(5)], "doc_id bigint, seq bigint, layout_state string")
    found = apply(spark, "flt17_sibling_pattern", items=df, jn03_alignment_lookup=aligned, toc_regions=spark.createDataFrame(list(regions), NO_REGIONS))
    return [r.seq for r in found.collect() if r.sibling]


def test_structural_siblings(spark, items):
    assert siblings(spark, items) == [2]
    assert siblings(spark, items, item(4, "After", "section_header", 3)) == []
    assert siblings(spark, items, item(1, "cell", "caption")) == []
    assert siblings(spark, items, item(3, "foot", layer="furniture")) == []
    assert siblings(spark, items, item(2, "Sibling", left=74.0)) == [] and siblings(spark, items, item(2, "Sibling", left=73.0)) == [2]
    assert siblings(spark, items, item(2, "3. Sibling")) == [] and siblings(spark, items, item(2, "x" * 161)) == [] and siblings(spark, items, item(2, "x" * 160)) == [2]
    assert siblings(spark, items, item(4, "After", "section_header", 2, page=2)) == []
    assert siblings(spark, items, state="ambiguous") == [] and siblings(spark, items, regions=[(1, 0, 2)]) == []


SUPPORTED = "doc_id bigint, seq bigint, role string, level bigint, left_pt double, kind string, supported bigint"


def transfers(spark, *rows_):
    df = spark.createDataFrame([(1, k, role, level, left, kind, sup) for k, (role, level, left, kind, sup) in enumerate(rows_)], SUPPORTED)
    return rows(apply(spark, "win08_local_level_transfer", supported_levels=df), "before", "after", "members", "level")


def test_local_level_transfers(spark):
    a, text = ("section_header", 1, 72.0, "decimal", 1), ("text", None, 72.0, "none", None)
    skips, fits, b = ("section_header", 4, 72.0, "none", None), ("section_header", 2, 72.5, "none", None), ("section_header", 2, 72.0, "decimal", 2)
    assert transfers(spark, a, skips, text, fits, b) == [(0, 4, 2, 2)]
    assert transfers(spark, a, fits, fits, b) == []  # all could be what they are
    assert transfers(spark, a, skips, b) == []  # no cluster
    assert transfers(spark, a, skips, fits, ("section_header", 1, 72.0, "decimal", 1)) == [(0, 3, 2, None)]  # the later one is not one level below
    assert transfers(spark, a, skips, fits, ("section_header", 2, 80.0, "decimal", 2)) == [(0, 3, 2, None)]  # not in line
    assert transfers(spark, a, skips, fits) == [(0, None, 2, None)]  # nothing later
    assert transfers(spark, skips, skips, a) == []  # nothing earlier
    assert transfers(spark, a, skips, ("section_header", 2, 74.0, "none", None), b) == []  # edges too far apart
    own = ("section_header", 5, 72.0, "none", 3)
    assert transfers(spark, a, fits, own, fits, b) == [(0, 4, 3, 2)]  # a supported heading that skips a level


def test_calibration_stays_in_its_scope(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 3), (1, 2, 1, 1, 1, 2, None), (1, 3, 1, 2, 1, 1, None)], "doc_id bigint, seq bigint, level bigint, regime_no bigint, root_level bigint, depth bigint, anchor_level bigint")
    assert rows(apply(spark, "jn13_earlier_anchor", numbered=df), "seq", "calibration") == [(1, None), (2, 2), (3, None)]


def test_identity_changes_of_one_source(spark):
    s = "source_id bigint, terminal_state string, failure_class string"
    old, new = spark.createDataFrame([(1, "complete", None), (2, "complete", None), (3, "failed", "x")], s), spark.createDataFrame([(1, "failed", "x"), (2, "complete", None)], s)
    assert rows(apply(spark, "jn31_identity_changes", candidates=old, later_candidates=new), "source_id", "field") == [(1, "failure_class"), (1, "terminal_state")]


def test_rule_summary_joins_counts_and_not_decisions(spark):
    """Each side of the join by inequality holds a row for each list of rules at most, however many decisions there are."""
    from folioforge.plans.catalog import apply

    rules = spark.createDataFrame([("R01",), ("R05",), ("R07",), ("R08",)], "rule string")
    rows = [("R01 R08", "R01")] * 400 + [("R05 R08", "R05")] * 300 + [("R05 R08", "R08")] * 7 + [("R08", "R08")] * 20 + [("", ""), (None, None), ("R08", None)]
    got = apply(spark, "agg05_rule_summary", rule_numbers=rules, decisions=spark.createDataFrame(rows, "eligible string, selected string"))
    assert {(r.rule, r.selected, r.eligible_only) for r in got.collect()} == {("R01", 400, 0), ("R05", 300, 7), ("R07", 0, 0), ("R08", 27, 700)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate [eligible")
