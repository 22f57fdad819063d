from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs."""

    def build(rows, extra=()):
        full = [(i, t, "en" if k % 2 else "fr", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA)
        for c in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
        return df

    return build


#: Names that operators use inside; a caller's columns may have them too.
CLASHING = ("key", "token", "label", "component_id", "n", "size", "pattern", "u", "kept")
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "word " * 30_000), (7, "É ß – 漢字 🙂"), (None, "some text here of five words or more")]
