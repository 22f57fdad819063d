"""Sketches against sets: what peeling recovers, likeness of whole texts, and neighbours."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folioforge.llm.fingerprints import BODY, HEAD, fingerprints, peel, retried, sketch, subtract
from folioforge.llm.storage import Scratch

from .conftest import CLASHING, EDGES


def cut(text):
    out = set()
    for line in text.split("\n"):
        words = re.findall(r"[^ \t\n\x0B\f\r]+[ \t\x0B\f\r]*", line)
        pieces = [words[:HEAD]] + [words[k : k + BODY] for k in range(HEAD, len(words), BODY)]
        out |= {"".join(p).strip(" \t\x0b\f\r") for p in pieces if p}
    return out or ({text} if text else set())


def brute(rows):
    """Likeness of sets, for rows with different ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        sets = [cut(x) for x in (t, edited, after)]
        near = [len(sets[0] & x) / len(sets[0] | x) if sets[0] | x else 1.0 for x in sets[1:]]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *near)
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()}


def test_against_sets(make):
    rows = [r for r in EDGES if r != (5, "one two")] + [(5, "one two"), (20, "a b c d e f\ng h\n\n  a b c d  \n" * 3), (21, "." * 50), (22, "\n" * 9)]
    rows += [(100 + k, "\n".join(f"line {j} of {k // 3} with some words and more" + " word" * (j % 50) for j in range(k * 7))) for k in range(12)]
    df = fingerprints(make(rows, CLASHING))
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    want, have = brute(rows), got(df)
    assert {i: x for i, x in have.items() if x != want[i]} == {}
    assert have.keys() == want.keys()


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    df = fingerprints(docs)
    assert got(df) == brute(rows)
    prints = {}
    for r in df.join(docs, "doc_id").collect():
        assert prints.setdefault(r.text, r.fingerprint) == r.fingerprint


def test_repeated_and_single_rows(make):
    r = fingerprints(make([(1, "a b c d e")])).first()
    assert (r.near_next, r.n_chars) == (1.0, 9) and r.edited_sha256 == hashlib.sha256(b"a b ca b ").hexdigest()
    same = fingerprints(make([(1, "x y"), (1, "x y"), (2, "other text")])).collect()
    assert sorted(r.near_next for r in same) == [0.0, 0.0, 1.0]
    assert fingerprints(make([])).count() == 0


@pytest.mark.parametrize("sizes", [(0, 0, 0), (5, 3, 900), (0, 14, 2), (9, 9, 0)])
def test_peeling(spark, sizes):
    a, b, both = sizes
    def digests(name, n):
        return F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: F.xxhash64(x, F.col("id"), F.lit(name))).alias(name)

    df = spark.range(40).select("id", digests("a", a), digests("b", b), digests("c", both))
    told = df.withColumn("x", peel(subtract(sketch(F.concat("a", "c")), sketch(F.concat("b", "c"))))).collect()
    assert sum(r.x.done for r in told) >= 34
    assert all(sorted(r.x.only_a) == sorted(r.a) and sorted(r.x.only_b) == sorted(r.b) for r in told if r.x.done)


def test_retries_until_all_are_told_apart(spark):
    """Large differences, in tables of which some get stuck at first."""
    numbers = lambda lo, hi: F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda x: F.xxhash64(x, F.col("row")))
    pairs = spark.range(6).withColumnRenamed("id", "row").select("row", F.lit("next").alias("kind"), numbers(1, 6000).alias("a"), numbers(2001, 7500).alias("b"))
    assert {(r.only_a, r.only_b) for r in retried(pairs, Scratch(spark, "test")).collect()} == {(2000, 1500)}


def test_long_runs(make):
    n = 1_000_000
    rows = [(1, "." * n), (2, " " * n + "x" + " " * n), (3, "\n" * n), (4, "a." * (n // 2)), (5, "\t \n" * (n // 3))]
    assert got(fingerprints(make(rows))) == brute(rows)


def test_no_python_workers(spark, make):
    plan = fingerprints(make([(k, f"line {k}\nand more") for k in range(9)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
