"""Order of a document's records on documents made by hand."""

from __future__ import annotations

import pytest

from folioforge.operators.records import Broken, Walk, traverse
from folioforge.plans import queries
from folioforge.plans.catalog import over_folder

DATA = "/root/testdata/sf0.001"

BODY = ("body", 0, False, False)


def walk(children, captions=None, **changed):
    """(kind, pointer, part) of a document; ``changed``: nodes that are no plain body records, by t0, g0, p0, T0."""
    kinds = {"t": "texts", "g": "groups", "p": "pictures", "T": "tables"}
    name = lambda x: "#/body" if x == "body" else f"#/{kinds[x[0]]}/{x[1:]}"
    used = {x for k, v in [*children.items(), *(captions or {}).items()] for x in (k, *v)} | set(changed)
    nodes = {name(x): changed.get(x, BODY) for x in used if x != "body"}
    links = [{name(k): [name(x) for x in v] for k, v in (m or {}).items()} for m in (children, captions)]
    short = {name(x): x for x in used}
    return [(kind, short[p], part) if part else (kind, short[p]) for kind, p, _, part in Walk(nodes, *links).run()]


FURNITURE, INVALID = ("furniture", 0, False, False), ("body", 0, False, True)


def test_groups_expand_in_place_and_furniture_comes_last():
    assert walk({"body": ["g0", "t3"], "g0": ["t1", "g1"], "g1": ["t0", "t9"]}, t9=FURNITURE, t10=FURNITURE, t2=FURNITURE) == [("text", "t1"), ("text", "t0"), ("text", "t3"), ("text", "t2"), ("text", "t9"), ("text", "t10")]


def test_tables_emit_once_a_clean_table_then_captions():
    got = walk({"body": ["T0", "t5"], "T0": ["t1", "g0", "t3"], "g0": ["t2"]}, {"T0": ["t10", "t3"]}, T0=("body", 2, False, False))
    assert got == [("table", "T0", 1), ("table", "T0", 2), ("text", "t3"), ("text", "t10"), ("text", "t5"), ("suppressed", "t1"), ("suppressed", "t2")]


def test_covered_tables_keep_only_their_captions():
    assert walk({"body": ["T0"], "T0": ["t1"]}, {"T0": ["t2"]}, T0=("body", 2, True, False)) == [("text", "t2"), ("suppressed", "t1")]


def test_tables_without_rows_are_entered_and_captions_follow_once():
    assert walk({"body": ["T0"], "T0": ["t1", "t2"]}, {"T0": ["t2", "t3"]}) == [("table_without_rows", "T0"), ("text", "t1"), ("text", "t2"), ("text", "t3")]


def test_pictures_are_figures_with_captions_in_order_of_their_pointers():
    assert walk({"body": ["p0"], "p0": ["t1", "t11", "t12"]}, {"p0": ["t11", "t2"]}, t12=FURNITURE) == [("figure", "p0"), ("text", "t2"), ("text", "t11"), ("suppressed", "t1"), ("suppressed", "t12")]


def test_texts_without_a_place_are_left_out():
    assert walk({"body": ["t0", "t1"]}, t0=INVALID) == [("text", "t1"), ("suppressed", "t0")]


@pytest.mark.parametrize(
    ("children", "captions", "changed", "reason"),
    [
        ({"body": ["g0"], "g0": ["g1"], "g1": ["g0"]}, {}, {}, "cycle"),
        ({"body": ["T0"], "T0": ["T0"]}, {}, {}, "cycle"),
        ({"body": ["p0"], "p0": ["g0"], "g0": ["p0"]}, {}, {}, "cycle"),
        ({"body": ["t0", "t0"]}, {}, {}, "met twice"),
        ({"body": ["p0", "p0"]}, {}, {}, "met twice"),
        ({"body": ["p0", "p1"]}, {"p0": ["t0"], "p1": ["t0"]}, {}, "met twice"),
        ({"body": ["t0", "p0"], "p0": ["t0"]}, {}, {}, "suppressed after it was emitted"),
        ({"body": ["p0", "t0"], "p0": ["t0"]}, {}, {}, "emitted after it was suppressed"),
        ({"body": ["t0"]}, {}, {"t0": ("margin", 0, False, False)}, "unknown layer"),
    ],
)
def test_violations(children, captions, changed, reason):
    with pytest.raises(Broken) as e:
        walk(children, captions, **changed)
    assert e.value.args[0] == reason


def test_deep_nesting_needs_no_recursion():
    assert walk({"body": ["g0"], **{f"g{k}": [f"g{k + 1}"] for k in range(20_000)}, "g20000": ["t0"]}) == [("text", "t0")]


def test_documents(spark):
    nodes = [(1, "#/texts/0", None, None, None, None), (1, "#/texts/1", "furniture", 0, False, False), (2, "#/groups/0", "body", 0, False, False), (4, "#/tables/0", "body", 1, False, False), (None, "#/texts/0", None, 0, False, False)]
    edges = [(1, "#/body", 1, "#/texts/0", False), (2, "#/body", 1, "#/groups/0", False), (2, "#/groups/0", 1, "#/groups/0", False), (3, "#/body", 1, "#/texts/7", False), (4, "#/body", 1, "#/tables/0", False), (5, "#/body", 1, "nowhere", False)]
    got = traverse(
        spark.createDataFrame(nodes, "doc_id bigint, pointer string, layer string, tables bigint, covered boolean, unplaced boolean"),
        spark.createDataFrame(edges, "doc_id bigint, parent string, position bigint, child string, caption boolean"),
    )
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 1, "text", "#/texts/0", "body", None, None), (1, 2, "text", "#/texts/1", "furniture", None, None), (2, 1, "violation", "#/groups/0", None, None, "cycle"),
        (3, 1, "violation", "#/texts/7", None, None, "unknown pointer"), (4, 1, "table", "#/tables/0", "body", 1, None), (5, 1, "violation", "nowhere", None, None, "not a pointer"),
    ]


def test_documents_are_read_in_batches_in_their_parts(spark, monkeypatch):
    monkeypatch.setattr(queries, "DOCUMENTS_PER_STAGE_PART", 20, raising=False)
    plain = traverse(*(over_folder(spark, DATA, name) for name in ("record_nodes", "record_edges")))
    assert "FlatMapCoGroups" not in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, queries.QUERIES["grf01_record_traversal"](spark, DATA).collect())) == sorted(map(str, plain.collect()))
