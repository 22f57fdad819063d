"""The registered queries against their SQL, and the pipeline's stages against each other."""

from __future__ import annotations

import pytest
from compare import connect, difference

from folioforge.llm.queries import QUERIES
from folioforge.llm.sql import ORACLE_SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_agree(spark, name):
    assert difference(QUERIES[name](spark, DATA), connect(DATA), ORACLE_SQL[name]) == ""


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] > 150
    assert corpus_pipeline.run(spark, DATA).count() == kept[-1]


def test_pipeline_with_clashing_columns(spark, make):
    """Stages pass on columns whose names operators or stages use themselves."""
    import corpus_pipeline

    names = ("score", "lang_pred", "row", "id", "all", "lines", "_lang", "kept", "first", "size", "line", "wanted")
    docs = make([(k, f"the of and to in is that it for with as on this was by {k}\nown line {k} of text") for k in range(8)] + [(None, None), (9, "")], names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert set(names) <= set(docs.columns), name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert 1 <= docs.count() <= 8


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
