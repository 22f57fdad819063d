from __future__ import annotations

import random

import numpy as np
import pytest
from llm.conftest import CLASHING, EDGES
from pyspark.sql import functions as F

from folioforge.llm import postings
from folioforge.llm.line_dedup import BANDS, ROWS, Lines, drop_duplicate_lines, line_components, signatures
from folioforge.llm.near_duplicates import drop_near_duplicates, near_duplicates


def brute(sets: dict, percent: int) -> dict:
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def dispersed(n: int, words: int = 120, seed: int = 3):
    """Copies of one text with more and more words changed: many pairs are alike, many more are not."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out + [(n + i, " ".join(f"y{rng.randrange(3000)}" for _ in range(60))) for i in range(30)]


@pytest.mark.parametrize("big", [4, 10_000])
def test_dispersed_group_equals_brute_force(spark, make, monkeypatch, big):
    """Both ways of comparing, blocks and pairs, give the components of all links."""
    monkeypatch.setattr(postings, "BIG", big)
    monkeypatch.setattr(postings, "CHUNK", 16)
    monkeypatch.setattr(postings.split_by_cluster, "__defaults__", (big,))
    rows = dispersed(90)
    sets = {i: shingles(t) for i, t in rows}
    want = brute(sets, 75)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make(rows)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_edge_cases(spark, make):
    got = near_duplicates(make(EDGES, CLASHING)).collect()
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)
    assert rows == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(4, None)]
    left = drop_near_duplicates(make(EDGES, CLASHING))
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 6, 7, None} and set(CLASHING) <= set(left.columns)


def test_rows_are_told_apart_by_id_and_text(spark, make):
    """Rows that share an id, or have none, go by their own text; of equal rows one stays."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "own words of the third text here"
    rows = [(2, a), (1, a), (2, b), (3, b), (None, a), (None, c), (None, c), (2, b), (4, "")]
    left = sorted(((r.doc_id or 0), r.text) for r in drop_near_duplicates(make(rows, CLASHING)).collect())
    assert left == [(0, c), (1, a), (2, b), (4, "")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(make(rows)).collect()}
    assert got == {(2, 1), (1, 1), (2, 2), (3, 2), (None, 1), (None, None), (4, 4)}
    named = make([(k, t) for k, t in rows if k]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.component_id for r in near_duplicates(named).collect()} == {"d1", "d2", "d4"}
    lines = [(2, "shared line number one\nprivate to the first"), (2, "shared line number one\nprivate to the second"), (None, "shared line number one\nprivate to none")]
    kept = sorted(r.text for r in drop_duplicate_lines(make(lines, CLASHING), min_chars=1).collect())
    assert sum("shared" in t for t in kept) == 1 and sum("private" in t for t in kept) == 3


def test_banding_recall():
    """Pairs of lines at a similarity of 0.75 to 0.8 share a band: at least 99 in 100 of them."""
    rng = np.random.default_rng(7)
    found, total = 0, 0
    with np.errstate(over="ignore"):
        for _ in range(1500):
            size = int(rng.integers(50, 400))  # of the union
            both = -(-int(size * rng.integers(7500, 8000)) // 10000)
            pool = rng.integers(1, 1 << 63, size, dtype=np.uint64)
            half = both + (size - both) // 2
            sets = pool[:half], np.concatenate((pool[:both], pool[half:]))
            sig = [signatures(x, np.array([len(x)]), BANDS * ROWS).reshape(BANDS, ROWS) for x in sets]
            found += bool((sig[0] == sig[1]).all(1).any())
            total += 1
    assert found >= 0.99 * total


def test_empty_tables(spark, make):
    assert near_duplicates(make([])).count() == 0
    assert line_components(make([])).count() == 0
    assert drop_duplicate_lines(make([])).count() == 0


def test_fuzzy_lines_equal_brute_force(spark, make):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ber", "tion", "qua", "lo", "mi") for b in ("sen", "ta", "gru", "pel", "nor")]
    base = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(6)]
    rows = []
    for i in range(40):
        line = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            line[rng.randrange(len(line))] = rng.choice("xyz")
        rows.append((i, "short\n" + "".join(line) + "\n" + " ".join(rng.choice(words) for _ in range(12))))
    lines = {(i, k): x for i, t in rows for k, x in enumerate(t.split("\n")) if len(x) >= 40}
    comp = brute({p: {x[j : j + 8] for j in range(len(x) - 7)} for p, x in lines.items()}, 75)
    sizes: dict = {}
    for c in comp.values():
        sizes[c] = sizes.get(c, 0) + 1
    want = {(*p, *c): p == c for p, c in comp.items() if sizes[c] > 1}
    got = {(r.doc_id, r.line, r.first_doc, r.first_line): r.kept for r in line_components(make(rows)).collect()}
    assert got == want


def test_lines_are_dropped_once(spark, make):
    long = "this is a line of more than forty characters in all"
    rows = [(1, f"first\n{long}\nend"), (2, f"{long}\nown words of the second document, which are long enough"), (3, long), (4, None), (5, "")]
    got = {r.doc_id: r.text for r in drop_duplicate_lines(make(rows, ("line", "kept"))).collect()}
    assert got == {1: rows[0][1], 2: "own words of the second document, which are long enough", 4: None, 5: ""}


def test_line_edges(spark, make):
    got = drop_duplicate_lines(make(EDGES, CLASHING)).collect()
    assert len(got) == len(EDGES)


def test_lines_of_a_block_are_those_of_split():
    """Texts that end in newlines share a place with the text after them."""
    texts = ["aaa\n", "bbb\nccc", "", "ddd\n\n\n", "", "\n", "é\nfff\n", "ggg", "hhh\n"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    with np.errstate(over="ignore"):
        lines = Lines(np.frombuffer(b"".join(data), np.uint8), offsets, 1)
    found = [lines.points[a:b].tobytes().decode("utf-32-le") for a, b in zip(lines.start, lines.end, strict=True)]
    want = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x]
    assert list(zip(lines.doc.tolist(), lines.number.tolist(), found, strict=True)) == want


def test_stage_and_query_judge_short_lines(spark, make, tmp_path):
    import corpus_pipeline
    from folioforge.llm.queries import op7_line_dedup

    rows = [(1, "own a\nReleased under the MIT License.\n}\n\n \nend"), (2, "own b\n}\nReleased under the MIT Licence.\n\n \nfin"), (3, "}\n"), (4, "x\ny\nx")]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, make(rows), "").collect()}
    assert got == {1: rows[0][1], 2: "own b\n\n \nfin", 4: "x\ny"}
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.line, r.first_doc, r.first_line, r.kept) for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {(1, 1, 1, 1, True), (2, 2, 1, 1, False), (1, 2, 1, 2, True), (2, 1, 1, 2, False), (3, 0, 1, 2, False), (4, 0, 4, 0, True), (4, 2, 4, 0, False)}


def test_pairs_are_verified_by_head(spark, monkeypatch):
    """Every pair is compared, however many a head has; pairs without a text give no link."""
    monkeypatch.setattr(postings, "QUERIES", 3)
    texts = {k: set(range(k % 4, 10)) for k in range(20)} | {50: set(range(2, 10))}
    blobs = spark.createDataFrame([(k, " ".join(map(str, sorted(v)))) for k, v in texts.items()], "key bigint, text string")
    pairs = [(a, b) for b in (0, 50, 99) for a in (*range(1, 20), 98)] + [(0, 50)]
    found = postings.verified(spark.createDataFrame(pairs, "a bigint, b bigint"), blobs, lambda column: [np.array(sorted(map(int, x.split())), np.uint64) for x in column.to_pylist()], 80, 4)
    want = {(a, b) for a, b in pairs if a in texts and b in texts and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


@pytest.mark.parametrize("run", [near_duplicates, lambda docs: line_components(docs, min_chars=1)])
def test_tables_that_no_step_reads_any_more_are_gone(spark, make, run):
    from pathlib import Path

    from folioforge.llm.storage import shared_root

    root = Path(shared_root(spark).removeprefix("file://"))
    before = set(root.glob("*/*"))
    run(make(dispersed(20))).collect()
    left = {p.name for p in set(root.glob("*/*")) - before}
    assert left and not left & {"live", "mixed-1", "mixed-2", "entries", "blobs", "links-1-pairs"}


def test_texts_are_dealt_once_and_packed(spark, make):
    from folioforge.llm.near_duplicates import _blobs
    from folioforge.llm.storage import unpacked

    rows = [(i, f"{'word ' * 40}{i % 5} é") for i in range(20)]
    blobs = _blobs(make(rows), spark.createDataFrame([], "key bigint"), 5, 3)
    assert blobs.count() == 0 and blobs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    keys = _blobs(make(rows), blobs.sparkSession.range(0).toDF("key"), 5, 3)
    assert keys.schema["text"].dataType.simpleString() == "binary"
    import pyarrow as pa

    from folioforge.llm.storage import pack_text

    for text in ("", "é\n" * 9, "a\x00b"):
        assert unpacked(pa.array([pack_text(text)])) == [text]
    assert len(pack_text(rows[0][1])) < len(rows[0][1])


def test_only_pairs_that_share_enough_are_verified(spark, make, monkeypatch):
    """Texts of classes that meet in fewer shingles than similar ones must share are not fetched."""
    asked, verified = [], postings.verified

    def spy(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(postings, "verified", spy)
    rng = random.Random(7)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    rows = [(i, " ".join(w[:30] + words[i // 2][:6] + w[30:])) for i, w in enumerate(words)]
    got = near_duplicates(make(rows), sketch_bits=6)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i) for i in range(40)} and asked == [0, 0, 0]
    near_duplicates(make([*rows, (99, rows[3][1] + " more")]), sketch_bits=6).collect()
    assert asked[3] == 1


def test_texts_of_classes_stay_dealt(spark):
    from folioforge.llm.storage import Scratch

    rows = spark.range(50).selectExpr("id as key", "cast(id as string) as text").repartition(4, "key")
    held = Scratch(spark, "dealt").save_dealt(rows, "blobs", 4, "key")
    both = held.hint("merge").join(spark.range(40).withColumnRenamed("id", "key"), "key")
    assert both.count() == 40 and not spark.sql("show tables").where("tableName like 'folioforge%'").count()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the other side


@pytest.mark.parametrize(("edges", "rounds"), [([], 0), ([(1, 5), (7, 1), (9, 8), (9, 8), (3, 3), (None, 4)], 0), ([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95)], None)])
def test_rounds_end_when_only_stars_are_left(spark, monkeypatch, edges, rounds):
    """No round is spent on finding that nothing changes."""
    from folioforge.llm import graph
    from folioforge.llm.storage import Scratch

    calls, toward = [], graph._toward_minimum
    monkeypatch.setattr(graph, "_toward_minimum", lambda pairs: calls.append(1) or toward(pairs))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "stars")).collect()}
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in edges:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert rounds is None or len(calls) == 2 * rounds


def test_empty_bins_borrow_without_a_pass_for_each_attempt(monkeypatch):
    """Signatures are those of asking bin after bin, also of lines with one shingle, where hundreds of attempts fail."""
    import numpy as np

    from folioforge.llm import line_dedup
    from folioforge.llm.kernels import U64, mix

    count = np.array([1, 2, 500, 1, 7, 60])
    hashes = mix(np.arange(int(count.sum()), dtype=U64) + U64(5))
    with np.errstate(over="ignore"):
        line_dedup.signatures(hashes, count, 56)
        calls = []
        monkeypatch.setattr(line_dedup, "mix", lambda x: calls.append(1) or mix(x))
        got = line_dedup.signatures(hashes, count, 56)
        assert len(calls) == 0
        for row, h in zip(got, np.split(hashes, np.cumsum(count)[:-1]), strict=True):
            least = {}
            for x in h.tolist():
                b = ((x >> 32) * 56) >> 32
                least[b] = min(least.get(b, 1 << 32), x & 0xFFFFFFFE)
            for b in range(56):
                at, attempt = b, 0
                while at not in least:
                    attempt += 1
                    at = int(mix(np.array([b * 1000003 + attempt], U64))[0] % U64(56))
                assert row[b] == least[at]
