"""Cross-tokenizer alignment against whole texts encoded by the tokenizers' own files and counted in memory."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from folioforge.llm.alignment import TOKENIZERS, Pair, align, encode_texts, merge_counts

from .conftest import CLASHING, EDGES



def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    letters = _byte_letters()

    def one(text):
        if not text:
            return None
        ia = a.encode(" " + text, add_special_tokens=False).ids
        ib = b.encode(text)
        pa_ = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        pb_ = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        whole = (" " + text).encode()
        if b"".join(pa_) != whole or b"".join(pb_) != whole:
            return None
        spans = []
        for ids, parts in ((ia, pa_), (ib, pb_)):
            at, out = 0, []
            for i, p in zip(ids, parts, strict=True):
                out.append((at, at + len(p), i))
                at += len(p)
            spans.append(out)
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((spans[1][k][2], i))
                k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begun = [], 0
        sides = [iter(x) for x in spans]
        for end in ends:
            cut = []
            for side in sides:
                got, at = [], begun
                while at < end:
                    _, at, i = next(side)
                    got.append(str(i))
                cut.append(",".join(got))
            groups.append("|".join(cut))
            begun = end
        return len(ia), len(ib), groups, links

    def corpus(rows):
        found = [one(t) for _, t in rows]
        counts = Counter(x for f in found if f for x in f[3])
        most = {}
        for (b_, _), n in counts.items():
            most[b_] = max(most.get(b_, 0), n)
        out = []
        for (i, _), f in zip(rows, found, strict=True):
            if f is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
            else:
                best = sum(counts[x] == most[x[0]] for x in f[3])
                out.append((i, f[0], f[1], len(f[2]), len(f[3]), best, sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
        return sorted(out, key=repr)

    return corpus


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (20, "two  spaces, three   and\n  a line\t\ttab \n"), (21, " leading and trailing "), (22, "<|endoftext|> <s> </s> <unk> <0x41> it's we'll"), (23, "already ▁ there"),
    (24, " no break 　wide\x1c \x85 x"), (25, "ﬁ Å é \U0001f600‍\U0001f600"), (26, "\x00 \x01"), (27, "a" * 70_000), (28, " " * 50_000 + "x"), (29, "\n" * 50_000), (30, "." * 50_000),
    (31, "12345 678 9,000.50"), (32, " "), (33, "▁"), (34, "x   y ­ z"),
]


def test_against_whole_texts(make, brute):
    rows = EDGES + ODD
    got = align(make(rows, CLASHING))
    assert got.columns == list(COLUMNS)
    ours, theirs = sorted((tuple(r) for r in got.collect()), key=repr), brute(rows)
    apart = [x for x in zip(ours, theirs, strict=True) if x[0] != x[1]]
    assert not apart, "\n".join(map(str, apart))


def test_many_runs(make, brute):
    """Runs of a few records and more radix partitions than Spark has partitions."""
    rows = [(k, f"the word {k % 7} of and th{'e' * (k % 5)} under line{k % 3}\nnext, item {k}") for k in range(120)]
    got = align(make(rows), radix=37, run_records=90)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_tables(spark, brute):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in align(docs).collect()), key=repr) == brute(rows)


def test_empty_table(make):
    assert align(make([])).count() == 0


def test_half_a_surrogate_pair_has_no_tokens():
    assert list(encode_texts(["x \ud800 y", "x y"], Pair(TOKENIZERS)))[0] == ((0, 0, 0, 0), "", [])


def test_merge_counts():
    """Sides stay whole in a block, ties are all strong, and links of all streams are added."""
    streams = [[(1 << 4 | 2) << 33 | 3, (2 << 4 | 1) << 33 | 1], [(1 << 4 | 2) << 33 | 2, (1 << 4 | 3) << 33 | 5], [(3 << 4 | 1) << 33 | 9]]
    blocks = [list(zip(*(x.tolist() for x in b), strict=True)) for b in merge_counts([iter(s) for s in streams], 4, block=1)]
    assert blocks == [[(18, 5, True), (19, 5, True)], [(33, 1, True)], [(49, 9, True)]]
