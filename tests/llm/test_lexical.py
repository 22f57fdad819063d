"""Ranked search against scores of all documents, and treaps against plain grids."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm.lexical import build, descend, dump, load, rank

from .conftest import CLASHING, EDGES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(ASCII)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    documents, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in dict.fromkeys(items):
        asked = set(TERM.findall((text or "").translate(ASCII)))
        found = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * documents) // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1))) * ((1000000000 * b[w]) // (1000 * b[w] + 8 * m)) for w in asked if b[w])
            found += [(-score, i is not None, i, score)] if score > 0 else []
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, key string" if rows and len(rows[0]) == 3 else "item_id bigint, text string")


def test_edges(spark, make):
    items = [(1, "one TWO word"), (1, "one TWO word"), (1, "text here"), (2, None), (3, "..."), (4, "nowhere"), (None, "É ß 漢字"), (5, "word " * 20_000 + "two")]
    got = rank(make(EDGES, CLASHING), items_of(spark, [(*x, "k") for x in items]))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(EDGES, items)


def test_many_treaps_and_blocks(spark, make):
    """Ties, repeated rows, small treaps and small blocks of items."""
    docs = [(k, " ".join(f"w{(k * j) % 23}" for j in range(1, 4 + k % 9)) + (" the" * (k % 4))) for k in range(400)] + [(7, "w1 w2"), (7, "w1 w2")] + [(1000 + k, "w5 w6 same") for k in range(30)]
    items = [(k, f"w{k} the w{(k * 7) % 23} w{k + 11}") for k in range(20)] + [(99, "same w5")]
    got = rank(make(docs), items_of(spark, items), cells=150, block_terms=9)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark, make):
    some = make([(1, "a b")])
    assert rank(make([]), items_of(spark, [(1, "a")])).count() == 0
    assert rank(some, items_of(spark, [])).count() == 0
    assert rank(make([(1, None), (2, "-")]), items_of(spark, [(1, "a")])).count() == 0


def test_long_runs(spark, make):
    docs = [(1, "." * 1_000_000), (2, " " * 1_000_000 + "needle"), (3, "9" * 1_000_000), (4, "\n" * 1_000_000), (5, "needle hay")]
    items = [(1, "needle"), (2, "9" * 1_000_000)]
    assert sorted((tuple(r) for r in rank(make(docs), items_of(spark, items)).collect()), key=repr) == brute(docs, items)


cells = st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 70)), st.integers(1, 1_000_000), min_size=1, max_size=120)


@settings(max_examples=60, deadline=None)
@given(cells, st.lists(st.integers(0, 40), min_size=1, max_size=6, unique=True), st.integers(1, 12))
def test_treap(grid, rows, k):
    """A stored treap gives the cells back, and descending it gives the greatest sums, none of them missed."""
    row, column, value = (np.array(x) for x in zip(*((r, c, v) for (r, c), v in grid.items()), strict=True))
    treap, ids = load(dump(*build(row, column, value), pa.array(range(71))))
    assert len(ids) == 71 and treap.maxima[0] == value.max()
    known = [r for r in rows if r <= row.max()]
    if not known:
        return
    weights = np.arange(1, len(known) + 1)
    sums = {}
    for (r, c), v in grid.items():
        if r in known:
            sums[c] = sums.get(c, 0) + v * int(weights[known.index(r)])
    found = dict(descend(treap, np.array(known), weights, [], k))
    assert all(sums[c] == s for c, s in found.items())
    assert sorted(sums.values(), reverse=True)[:k] == sorted(found.values(), reverse=True)[:k]
    least = sorted(sums.values(), reverse=True)[:k][-1] if sums else 0
    assert {c for c, s in sums.items() if s >= least} <= set(found)
