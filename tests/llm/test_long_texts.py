"""Texts of a megabyte that patterns could choke on: every operator gets through them in reasonable time."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

N = 1_000_000
LONG = [
    (1, "x@" + "a." * 30_000 + "com and x@a.b.example.org"), (2, "a" + " " * N + "b"), (3, "." * N), (4, "7" * N), (5, "\n" * N), (6, "a@" * (N // 2)), (7, "same line of text here\n" * 60_000),
    (8, "+1 " * (N // 3)), (9, "12.34." * (N // 6)), (10, "token=" * (N // 6)), (11, "漢" * 300_000), (12, "a-b " * (N // 4)),
]


@pytest.fixture
def clock():
    began = time.time()
    yield
    assert time.time() - began < 240


def test_pseudonyms(make, clock):
    from folioforge.llm.pseudonyms import pseudonymize

    got = {r.doc_id: r for r in pseudonymize(make(LONG), key="k").collect()}
    assert len(got) == len(LONG) and "@a.b.example.org" in got[1].text and "x@a.b.example.org" not in got[1].text
    assert [got[k].text for k in (2, 3, 5)] == [t for k, t in LONG if k in (2, 3, 5)]
    deep = "y@" + "b." * 100 + "net"
    moved = pseudonymize(make([(1, deep)]), key="k")
    assert moved.first().n_email == 1 and pseudonymize(moved.drop("n_email"), key="k", inverse=True).first().text == deep


def test_quality(make, clock):
    from folioforge.llm.quality import judge

    got = {r.doc_id: r for r in judge(make(LONG)).collect()}
    assert got[2].n_words == 2 and got[2].word_chars == 2 and got[5].n_words == 0
    assert got[7].n_words == 300_000 and got[7].n_dup_lines == 59_999 and got[7].n_repeat_words == 300_000


def test_secrets(make, clock, tmp_path):
    from folioforge.llm.secrets import scan

    assert scan(make(LONG), f"file://{tmp_path}/ledger").count() == len(LONG)


def test_equal_lines_of_one_text(make, clock):
    from folioforge.llm.line_dedup import drop_duplicate_lines

    got = {r.doc_id: r.text for r in drop_duplicate_lines(make([(1, "head\n" + "same line of text here\n" * 60_000 + "tail"), (2, "other\nlines")]), min_chars=1).collect()}
    assert got == {1: "head\nsame line of text here\n\ntail", 2: "other\nlines"} or got[1].replace("\n", " ").split() == "head same line of text here tail".split()


def test_unlabelled_corpus_is_passed_on(spark, make):
    import corpus_pipeline

    docs = make([(1, "some text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 2]
