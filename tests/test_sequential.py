from __future__ import annotations

import datetime

from folioforge.operators import sequential
from folioforge.streaming.attempts import illegal_transitions, outcome_counts


def test_distinct_boxes_keep_the_largest(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1, 0.0, 0.0, 10.0, 9.9), (1, 3, 1, 20.0, 0.0, 30.0, 10.0)], "page bigint, box_id bigint, part_no int, l double, b double, r double, t double")
    assert {r.box_id for r in sequential.distinct_boxes(df).collect()} == {1, 3}


def test_boxes_of_many_pages_are_one_pass(spark):
    """Groups are not handed over one by one; pages without a number and boxes without a place stay, and large kept boxes do not hide later ones."""
    rows = [(p, b, 1, 0.0, 0.0, 10.0 * b, 10.0) for p in (1, 2, None) for b in (1, 2, 3)] + [(1, 9, 1, 0.0, 0.0, 30.0, 9.8), (2, 9, 1, 0.0, float("nan"), 5.0, 5.0), (2, 8, 1, None, 0.0, 5.0, 5.0)]
    df = sequential.distinct_boxes(spark.createDataFrame(rows, "page bigint, box_id bigint, part_no int, l double, b double, r double, t double"))
    assert {(r.page, r.box_id) for r in df.collect()} == {(p, b) for p in (1, 2, None) for b in (1, 2, 3)} | {(2, 9), (2, 8)}
    assert "InPandas" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_grids_of_many_tables_are_one_pass(spark):
    rows = [(t, r, x) for t in (None, *range(3000)) for r, x in ((2, ["ucel", "fcel"]), (1, ["fcel", "fcel"]))] + [(-1, r, ["fcel"] * 40) for r in range(3)]
    df = sequential.grid_topology(spark.createDataFrame(rows, "table_id bigint, r int, tokens array<string>"))
    assert df.count() == 3001 * 3 + 120 and df.where("row_span = 2 and r = 0 and c = 0").count() == 3001
    assert "InPandas" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_regions_take_the_best_remaining_table(spark):
    s = "page bigint, id bigint, l double, b double, r double, t double"
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 9.0)], s)
    tables = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 10.0), (1, 8, 50.0, 50.0, 60.0, 60.0)], s)
    assert [(r.region_id, r.table_id) for r in sequential.match_regions(regions, tables).collect()] == [(1, 7)]


def test_rejected_spans_do_not_move_the_frontier(spark):
    df = spark.createDataFrame([(1, 1, "a", 0, 5), (1, 1, "b", 3, 20), (1, 1, "c", 6, 8)], "doc_id bigint, seq bigint, kind string, s bigint, e bigint")
    assert {r.kind for r in sequential.select_spans(df).collect()} == {"a", "c"}


def test_families_refuse_two_tables_of_a_page(spark):
    tables = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 1), (1, 3, 2, 2)], "doc_id bigint, table_id bigint, page bigint, page_table_index bigint")
    edges = spark.createDataFrame([(1, 1, 2, 0), (1, 1, 3, 1)], "doc_id bigint, a bigint, b bigint, rank bigint")
    assert {(r.table_id, r.family_no, r.member_no) for r in sequential.table_families(edges, tables).collect()} == {(1, 1, 1), (2, 1, 2), (3, 2, 1)}


def test_grid_topology_spans(spark):
    tables = {1: [["fcel", "lcel"], ["ucel", "xcel"]], 2: [["fcel", "bad"]], 3: [["fcel"], ["fcel", "fcel"]], 4: [["lcel", "fcel"]], 5: [["fcel", "fcel"], ["ucel", "xcel"]], 6: [["fcel", "lcel"], ["ucel", "fcel"]], 7: [["ched", "lcel", "fcel"], ["rhed", "ecel", "ucel"]], 8: [[]]}
    df = spark.createDataFrame([(t, r, x) for t, rows in tables.items() for r, x in enumerate(rows, 1)], "table_id bigint, r int, tokens array<string>")
    got = [tuple(r) for r in sequential.grid_topology(df).orderBy("table_id", "r", "c").collect()]
    none = (None,) * 5
    assert got == [
        (1, 0, 0, 2, 2, "fcel", None), (2, *none, "unknown token"), (3, *none, "rows of different lengths or none"), (4, *none, "a continuation of nothing"), (5, *none, "a continuation of nothing"), (6, *none, "a cell that is no rectangle"),
        (7, 0, 0, 1, 2, "ched", None), (7, 0, 2, 2, 1, "fcel", None), (7, 1, 0, 1, 1, "rhed", None), (7, 1, 1, 1, 1, "ecel", None), (8, *none, "rows of different lengths or none"),
    ]


def _run(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"select * from {name}").collect()


def test_stream_of_attempts(spark, tmp_path):
    rows = [(1, 1, "selected"), (1, 2, "running"), (1, 3, "complete"), (2, 1, "running"), (2, 2, "selected")]
    spark.createDataFrame(rows, "transaction_id bigint, sequence bigint, state string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("transaction_id bigint, sequence bigint, state string").parquet(str(tmp_path / "in"))
    assert {(r.transaction_id, r.sequence) for r in _run(spark, illegal_transitions(stream), "illegal", tmp_path)} == {(2, 1), (2, 2)}


def test_windowed_counts_drop_late_rows_only(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 0, 0)
    rows = [(t, "view", 1.0), (t + datetime.timedelta(minutes=5), "view", 2.0), (t + datetime.timedelta(hours=3), "click", 1.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    assert [(r.event_type, r.n, r.value) for r in _run(spark, outcome_counts(stream), "counts", tmp_path)] == [("view", 2, 3.0)]
