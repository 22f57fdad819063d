from __future__ import annotations

import pytest

from folioforge.sources import io


def test_jsonl_round_trip_and_seal(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.5)], "seq bigint, name string, x double")
    io.write_jsonl(df, str(tmp_path / "out"), ["seq"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ['{"name":"a","seq":1,"x":1.5}', '{"name":"b","seq":2,"x":null}']
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "rows.jsonl").write_text(text + "\n")
    seal = spark.createDataFrame(io.inventory(spark, str(tmp_path / "s")).collect(), "path string, sha256 string, byte_size bigint")
    assert io.read_sealed(spark, str(tmp_path / "s"), seal, df.schema, "rows.jsonl").count() == 2
    (tmp_path / "s" / "rows.jsonl").write_text("{}\n")
    with pytest.raises(ValueError, match="changed"):
        io.read_sealed(spark, str(tmp_path / "s"), seal, df.schema, "rows.jsonl")


def test_bad_lines_and_arrays_fail(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="bad.jsonl"):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        io.read_json_object(spark, str(tmp_path / "list.json"), "a int")


def test_grid_round_trip(spark, tmp_path):
    rows = [("a,b", ""), ('q"x', "é")]
    io.write_grid(spark.createDataFrame(rows, "c0 string, c1 string").coalesce(1), str(tmp_path / "grid"))
    assert [tuple(r) for r in io.read_grid(spark, str(tmp_path / "grid"), 2).collect()] == rows


def test_publication_is_once(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "pub")
    with pytest.raises(FileNotFoundError):
        io.read_published(spark, path)
    assert io.publish(df, path, "d1") == "published" and io.publish(df, path, "d1") == "reused"
    assert io.read_published(spark, path).count() == 3
    with pytest.raises(ValueError):
        io.publish(df, path, "d2")


def test_product_replacement_keeps_others(spark, tmp_path):
    path = str(tmp_path / "products")
    for stage, n in (("a", 1), ("b", 2), ("a", 3)):
        io.replace_product(spark.range(n), path, "stage", stage)
    assert {r.stage: r["count"] for r in spark.read.parquet(path).groupBy("stage").count().collect()} == {"a": 3, "b": 2}
