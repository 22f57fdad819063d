"""Queries over large relations: memory of a task is bounded by the parts that tables are dealt in, not by the session's partitions."""

from __future__ import annotations

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from folioforge.plans import catalog, queries
from folioforge.plans.queries import QUERIES, oracles

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark, monkeypatch):
    """Small parts, no broadcasts and partitions as they are."""
    monkeypatch.setattr(catalog, "ROWS_PER_PART", 400)
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df) -> tuple[int, float]:
    """Parts with rows, and the share of the largest."""
    sizes = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    return len(sizes), max(sizes) / sum(sizes)


@pytest.mark.parametrize("name", ["agg10_column_signature", "srt10_family_order", "jn22_region_clean_table", "prj07_span_projection"])
def test_rows_stay_in_bounded_parts(plain, name):
    df = QUERIES[name](plain, DATA)
    parts, share = largest_share(df)
    assert parts > 10 and share < 0.2
    assert difference(df, connect(DATA), oracles()[name]) == ""


@pytest.mark.parametrize("name", ["scl26_record_references", "val10_status_target_count"])
def test_texts_are_searched_once(spark, name):
    assert not any("documents.parquet" in f for f in QUERIES[name](spark, DATA).inputFiles())


def test_headers_are_joined_where_their_tables_are(plain):
    plan = QUERIES["grf06_family_chains"](plain, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange hashpartitioning") <= 2


@pytest.mark.parametrize(("name", "exchanges"), [("scl11_row_cleanup", 1), ("prj15_inherited_headers", 2), ("grf06_family_chains", 2)])
def test_cells_of_a_row_stay_together(plain, name, exchanges):
    """Rows are dealt once by table and not blown up: no cell is a row of its own, and no row is repeated for each distinct count."""
    df = QUERIES[name](plain, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange hashpartitioning") <= exchanges
    assert "inline(" not in plan and "explode(array(" not in plan and "Expand" not in plan
    assert difference(df, connect(DATA), oracles()[name]) == ""


@pytest.mark.parametrize("name", ["row_texts", "headers", "column_types"])
def test_relations_in_rows_equal_those_over_cells(spark, name):
    rows = [(1, 1, ["extract_v2", None, "", "-", "7"]), (1, 2, ["Flag", "", None, "x", "12 of 3"]), (1, 3, ["1", "2", "-", "", "5"]), (2, 1, ["", "", "", "", ""]), (3, 1, ["1", "2", "a", "", ""]), (None, 1, ["a", "b", "1", "-", ""])]
    rows += [(4, r, [f"h{r}", "", None, "b", "-"]) for r in range(1, 12)]
    in_rows = spark.createDataFrame(rows, "table_id bigint, r bigint, texts array<string>")
    cells = in_rows.selectExpr("table_id", "r", "posexplode(texts) as (c, text)")
    a, b = catalog.apply(spark, name, cells=cells), catalog.apply(spark, f"{name}_in_rows", cell_rows=in_rows)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("name", ["grf12_rule_cascade", "win06_sparse_corrected", "grf13_section_placement"])
def test_stages_stay_in_the_parts_of_their_documents(spark, monkeypatch, name):
    plans = []

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, *args)

    kept = queries.kept
    monkeypatch.setattr(queries, "DOCUMENTS_PER_STAGE_PART", 20, raising=False)
    monkeypatch.setattr(queries, "kept", seen)
    df = QUERIES[name](spark, DATA)
    assert df.sparkSession is spark and difference(df, connect(DATA), oracles()[name]) == ""
    assert plans and not any(x in plans[-1] for x in ("Exchange hashpartitioning", "BroadcastExchange"))
