from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.plans.catalog import apply
from folioforge.plans.queries import QUERIES  # noqa: F401


def test_normal_forms(spark):
    df = spark.createDataFrame([("é  x\tStraße",), (None,), ("ﬁ ２",)], "s string")
    got = df.select(text.normalized(F.col("s"), fold=True).alias("a"), text.table_text(F.col("s")).alias("b")).collect()
    assert got[0].a == "é x strasse" and got[1].a is None and got[2].b == "fi 2"


def test_canonical_json(spark):
    assert text.canonical_json({"b": 1.0, "a": [True, None, "é\n"], "\U0001f600": 1e-7, "דּ": 2}) == '{"a":[true,null,"é\\n"],"b":1,"\U0001f600":1e-7,"דּ":2}'
    df = spark.createDataFrame([(json.dumps({"b": 1, "a": 2}),), (None,)], "j string")
    got = [r[0] for r in df.select(text.canonical_digest(F.col("j"), "exv1-")).collect()]
    assert got == ["exv1-" + hashlib.sha256(b'{"a":2,"b":1}').hexdigest(), None]


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a":[{"secret":1}],"t":1}', '{"a":[{"secret":2}],"t":9}')], "x string, y string")
    row = df.select(text.first_path_of_key(F.col("x"), "secret").alias("p"), text.json_differences(F.col("x"), F.col("y"), ("t",)).alias("d")).first()
    assert row.p == "/a/0/secret" and row.d == ["/a/0/secret"]


def test_multiset_digest(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, None)]
    one = text.multiset_digest(spark.createDataFrame(rows, "k int, v string")).first()
    two = text.multiset_digest(spark.createDataFrame(rows[::-1], "k int, v string").repartition(3)).first()
    shas = [int(hashlib.sha256(json.dumps({k: v for k, v in zip(("k", "v"), r) if v is not None}, separators=(",", ":")).encode()).hexdigest(), 16) for r in rows]
    xor = 0
    for s in shas:
        xor ^= s
    assert one == two and int(one.sum_hex, 16) == sum(shas) % 2**256 and int(one.xor_hex, 16) == xor
    assert text.multiset_digest(spark.createDataFrame([], "k int")).first().rows == 0


def test_apply_binds_frames(spark):
    headings = spark.createDataFrame([(1, 1, 1, 1, "a"), (1, 2, 1, 3, "b"), (1, 3, 1, 2, "c"), (1, 4, 1, 3, "d")], "doc_id bigint, seq bigint, page bigint, level bigint, title string")
    parents = {r.seq: r.parent_seq for r in apply(spark, "win04_hierarchy_parent", headings=headings).collect()}
    assert parents == {1: None, 2: 1, 3: 1, 4: 3}
