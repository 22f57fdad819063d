"""Tables of contents on items made by hand: ends of regions, and rows."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from folioforge.operators.contents import parse_rows, rows_of
from folioforge.plans.catalog import apply

FEATURES = "doc_id bigint, seq bigint, page bigint, role string, layer string, text string, l double, r double, b double"
H, T, F = ("section_header", "body"), ("text", "body"), ("page_footer", "furniture")


def regions(spark, items, outline=(), labels=()):
    """(start, end excluded, end of candidates, rule) of items (page, kind, text)."""
    rows = [(1, k, page, *kind, text, 0.0, 0.0, 0.0) for k, (page, kind, text) in enumerate(items)]
    found = apply(
        spark, "grf09_toc_regions", contents_features=spark.createDataFrame(rows, FEATURES),
        contents_outline=spark.createDataFrame([(1, *x) for x in outline], "doc_id bigint, position bigint, depth bigint, parent bigint, title string, page bigint"),
        printed_pages=spark.createDataFrame([(1, *x) for x in labels], "doc_id bigint, page bigint, label string"),
    )
    return [tuple(r)[1:] for r in found.orderBy("start_seq").collect()]


TOC = (1, H, "Table of  Contents")


def test_ends_at_the_page_of_the_next_outline_sibling(spark):
    items = [TOC, (1, T, "1. One ..... 3"), (2, T, "2. Two ..... 5"), (3, F, "footer"), (3, T, "body of one"), (4, H, "2. Two")]
    outline = [(0, 1, None, "volume", 1), (1, 2, 0, "table of contents", 1), (2, 3, 1, "below", 2), (3, 2, 0, "1. one", 3), (4, 1, None, "appendix", 4)]
    assert regions(spark, items, outline) == [(0, 4, 5, "outline_sibling")]


def test_outline_entries_that_do_not_tell_the_end(spark):
    items = [TOC, (1, T, "1. One ..... 3"), (2, H, "1. One"), (2, T, "text")]
    assert regions(spark, items, [(0, 1, None, "table of contents", 1)]) == [(0, None, None, "no_later_sibling")]
    assert regions(spark, items, [(0, 1, None, "table of contents", 1), (1, 2, None, "table of contents", 1), (2, 1, None, "1. one", 2)]) == [(0, None, None, "ambiguous_outline")]
    assert regions(spark, items, [(0, 1, None, "table of contents", 9)]) == [(0, 2, 4, "heading_repeat")]


def test_ends_where_pages_count_from_one_and_numbers_begin_anew(spark):
    items = [TOC, (1, T, "1.1 Scope"), (2, H, "1. Intro"), (2, T, "front matter"), (3, H, "12.4 Not a reset"), (3, T, "text"), (4, H, "1. Intro"), (4, T, "text"), (5, H, "2. Next")]
    roman = [(1, "iv"), (2, "v"), (3, "1"), (4, "1"), (5, "2")]
    assert regions(spark, items, labels=roman) == [(0, 6, 9, "page_reset")]
    assert regions(spark, items, labels=[(1, "4"), (4, "1")]) == [(0, 2, 9, "heading_repeat")]
    assert regions(spark, [*items[:7], (4, H, "x")], labels=roman)[0][3] == "heading_repeat"  # nothing but headings on the page


def test_ends_at_the_page_of_a_repeated_title_with_content(spark):
    items = [TOC, (1, T, "First part . . . ."), (1, T, "9"), (2, H, "First part"), (2, H, "Other"), (3, T, "opens the page"), (3, H, "First  PART"), (3, F, "footer"), (3, T, "content"), (4, H, "End")]
    assert regions(spark, items) == [(0, 5, 10, "heading_repeat")]
    assert regions(spark, items[:8]) == [(0, None, None, "unterminated")]


def test_any_number_of_rows_belongs_to_one_region(spark):
    items = [TOC, *[(1, T, f"{k}. Title {chr(65 + k % 26)}") for k in range(1, 40)], (2, H, "3. Title D"), (2, T, "text")]
    assert regions(spark, items) == [(0, 40, 42, "heading_repeat")]


def test_starts_inside_a_region_open_no_other(spark):
    again = (2, H, "TABLE OF CONTENTS (Continued)")
    items = [TOC, (1, T, "1. One"), again, (2, T, "2. Two"), (3, H, "1. One"), (3, T, "text"), TOC[:1] + TOC[1:], (4, T, "4. Four"), (5, H, "4. Four"), (5, T, "text")]
    items[6] = (4, H, "table of contents")
    assert [r[:2] for r in regions(spark, items)] == [(0, 4), (6, 8)]
    ended = apply(spark, "toc_regions", contents_kept=spark.createDataFrame([(1, 0, 4, 9, "x")], "doc_id bigint, start_seq bigint, end_seq bigint, candidate_end bigint, rule string"))
    assert [tuple(r) for r in ended.collect()] == [(1, 0, 3)]


def test_other_titles_and_furniture_open_nothing(spark):
    assert regions(spark, [(1, H, "List of tables"), (1, T, "Table of contents"), (1, ("section_header", "furniture"), "Table of contents")]) == []
    assert regions(spark, []) == []


def parsed(*texts, gap=1.0, page=1):
    """Rows of items; a tuple has a role beside its text."""
    items = []
    for k, x in enumerate(texts):
        text, role = x if isinstance(x, tuple) else (x, "text")
        items.append(SimpleNamespace(seq=k, page=page, role=role, text=text, l=10.0 * k, r=10.0 * k + 10 - gap, b=5.0))
    return [(m, t, p, s) for m, t, p, s, _ in rows_of(items)]


def head(text):
    return (text, "section_header")


BAD = (None, None, None)


@pytest.mark.parametrize(
    ("texts", "rows"),
    [
        (["1.2", "Long", "title", "....", "7"], [("1.2", "long title", "7", "complete")]),
        (["1.", "One", "..", "1", "2.", "Two", ".", "..", "B-2"], [("1.", "one", "1", "complete"), (*BAD, "no page after the leader")]),
        (["1.", "One", "..", "A1-2"], [("1.", "one", "A1-2", "complete")]),
        (["1", ".", "One", "...", "3"], [("1.", "one", "3", "complete")]),  # a period on its own belongs to the number before it
        (["1.2", "One . . .", "7"], [(*BAD, "digits at the end of a title")]),  # before a page a number counts as a marker only with a leader of its own
        (["Unnumbered . . . .", "4"], [(None, "unnumbered", "4", "complete")]),
        (["Article IV", "Scope", "...", "12"], [("Article IV", "scope", "12", "complete")]),
        (["Article IV", "Scope", "Article V", "More", "...", "9"], [("Article IV", "scope", None, "missing_printed_page"), ("Article V", "more", "9", "complete")]),
        (["Article I", "Scope"], [("Article I", "scope", None, "missing_printed_page")]),  # the end is enough after a marker that is no plain number
        (["3", "Tail"], [(*BAD, "neither marker nor title at the start"), (*BAD, "neither marker nor page")]),  # but not after a plain one, which may be a page
        (["One", "....", "7", "8", "Two", "...", "9"], [(None, "one", "7", "complete"), ("8", "two", "9", "complete")]),
        (["One", "....", "7", "8", "9"], [(None, "one", "7", "complete"), (*BAD, "neither marker nor title at the start"), (*BAD, "neither marker nor title at the start")]),
        (["One", "7"], [(*BAD, "a page before the leader")]),
        (["One", "....", "Two"], [(*BAD, "no page after the leader")]),
        (["One"], [(*BAD, "neither marker nor page")]),
        (["....", "1.", "A", "..", "2"], [(*BAD, "neither marker nor title at the start"), ("1.", "a", "2", "complete")]),
        (["1.", "Title12", "..", "2"], [(*BAD, "digits at the end of a title")]),
        (["Appendix A", "Form 12", "..", "2"], [("Appendix A", "form 12", "2", "complete")]),
        ([head("Appendix B"), "Maps", head("Appendix C"), "More", "..", "3"], [("Appendix B", "maps", None, "missing_printed_page"), ("Appendix C", "more", "3", "complete")]),
        (["1.", "One", "..", head("Table of Contents (continued)"), "5"], [(*BAD, "a continued heading interrupts the row"), (*BAD, "neither marker nor title at the start")]),
        ([head("TABLE OF CONTENTS (Continued)"), "1.", "One", "..", "5"], [("1.", "one", "5", "complete")]),
        (["1.", "One", "..", head("Summary"), "2.", "Two", "..", "5"], [("1.", "one", None, "missing_printed_page"), (*BAD, "unexpected heading"), ("2.", "two", "5", "complete")]),
        ([], []),
    ],
)
def test_rows(texts, rows):
    assert parsed(*texts) == rows


def test_a_distant_period_is_a_leader():
    assert parsed("1", ".", "One", "...", "3", gap=-9.0)[0][3] == "neither marker nor title at the start"


def test_rows_of_regions(spark):
    texts = ["1.2", " Long  title", "....", "7", None, "  ", "Appendix A", "Maps"]
    rows = [(1, 0, k + 1, 1, "text", t, 0.0, 0.0, 0.0) for k, t in enumerate(texts)] + [(1, 50, 51, 9, "text", "3.", 0.0, 0.0, 0.0), (1, 50, 52, 9, "text", "Other . .", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, start_seq bigint, seq bigint, page bigint, role string, text string, l double, r double, b double")
    got = sorted(tuple(r)[1:] for r in parse_rows(df).collect())
    assert got == [
        (0, 1, "1.2", "long title", "7", 2, "complete", [1, 2, 3, 4]),
        (0, 2, "Appendix A", "maps", None, 1, "missing_printed_page", [7, 8]),
        (50, 1, None, "3. other", None, 1, "missing_printed_page", [51, 52]),
    ]
    assert parse_rows(df.limit(0)).count() == 0
