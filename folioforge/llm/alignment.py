"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, counted over the corpus out of core.

Where tokens of A and of B both end, the text is cut into groups; an A token and a B token whose byte ranges overlap are
linked. A link is a *strong* one of its B token if no other A token is linked with that B id more often in the corpus.

1. One pass encodes every text. A text is first cut at spaces inside it that follow a character other than white space: neither
   tokenizer has a token across such a place (checked for B's vocabulary when it is loaded), so each distinct piece is
   encoded and aligned once, and remembered while its run lasts. Nothing of a text is left out.
2. A task gathers pair-document records (pair, document, links) up to ``run_records``, sorts them and writes them as one
   *run*: for each radix partition of B ids an index (pairs with their links) and the records themselves, both zstd.
3. Runs' indexes are dealt by radix partition; a k-way heap merge reads them in order of B id, then A id, so that when a
   B id ends its counts and their maximum are known, and answers go back to every run, block by block.
4. Answers meet the records of their run, which give each document its sums.

No task holds the records of a pair or of a B id: records stay with their run, whose size is bounded (a run has at least
one document), and a B id has at most one index entry per run and A id, so frequent tokens make no task large. Memory
of a merge grows with the runs' entries in a radix partition; ``radix`` (default: shuffle partitions) must follow the
number of runs. Runs are a table in the shared folder: a lost executor costs the tasks it ran.

Edge cases: texts that are null or empty, or whose tokens do not give back the bytes of a space and the text (B reads
U+2581 as a space, for one), have no tokens, zeros and an empty string. Rows are told apart by their place in a run, so
repeated, null or tied ids get a row each. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.storage import Scratch, mapped, partitions_for

TOKENIZERS = "/opt/tokenizers"
RUN_RECORDS = 2_000_000
DOC_BITS = 20
REMEMBERED = 400_000, 24_000_000  # pieces, and their characters: beyond these a run ends
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = 65_536
NONE = np.zeros(0, np.int64)


class Pair:
    """Both tokenizers, and pieces of text aligned by them."""

    def __init__(self, folder: str):
        import base64

        import sentencepiece
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:  # the vocabulary and merges of byte_bpe_50k.json
            ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
        # fixed value: how this public vocabulary cuts text before merging
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.a = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.bytes_a = {i: x for x, i in ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.size_a, self.size_b = max(ranks.values()) + 1, len(pieces)
        self.size = max(self.size_a, self.size_b)
        self.width_a, self.width_b = np.zeros(self.size_a, np.int64), np.array(list(map(len, self.bytes_b)))
        self.width_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.said = [f"{sep}{i}" for sep in ";|," for i in range(self.size)]
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}  # pieces in order of appearance
        self.groups: list[str] = []
        self.counts: list[tuple[int, ...]] = []  # as COUNTS; none where the bytes differ
        self.pairs: list[np.ndarray] = []  # links as side << 32 | A id
        self.chars = 0

    def pieces(self, text: str) -> list[str]:
        """Without the space before each."""
        if not self.cuts:
            return [text]
        return re.split(r"(?<=\S) (?!\Z)", text) if re.search(r"\s |\A | \Z", text) else text.split(" ")

    def learn(self, pieces: list[str]) -> None:
        """Encode and align pieces that are new, all at once."""
        for p in pieces:
            self.ids[p] = len(self.ids)
        a, b = [self.a.encode_ordinary(" " + p) for p in pieces], self.b.encode(pieces, num_threads=1)
        whole = [(" " + p).encode() for p in pieces]
        same = [b"".join([self.bytes_a[i] for i in x]) == w and b"".join([self.bytes_b[i] for i in y]) == w for x, y, w in zip(a, b, whole, strict=True)]
        self.chars += sum(map(len, pieces))
        found = self._cut([x for x, ok in zip(a, same, strict=True) if ok], [y for y, ok in zip(b, same, strict=True) if ok])
        for ok in same:
            groups, counts, pairs = next(found) if ok else ("", (), NONE)
            self.groups.append(groups)
            self.counts.append(counts)
            self.pairs.append(pairs)

    def _cut(self, a: list[list[int]], b: list[list[int]]) -> Iterator[tuple[str, tuple[int, ...], np.ndarray]]:
        """Of each of some texts that both tokenizers spell alike: its groups, COUNTS and links."""
        if not a:
            return
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        flat_a, flat_b = np.fromiter(chain.from_iterable(a), np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        ends_a, ends_b = np.cumsum(self.width_a[flat_a]), np.cumsum(self.width_b[flat_b])
        last = ends_a[np.cumsum(n_a) - 1]
        ends, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        pairs = flat_b[np.searchsorted(ends_b, ends)] << 32 | flat_a[np.searchsorted(ends_a, ends)]
        to = np.searchsorted(ends, last, "right")
        n_links, n_groups = np.diff(to, prepend=0), np.diff(np.searchsorted(common, last, "right"), prepend=0)
        in_a, in_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        sep = [np.where(np.diff(g, prepend=-1) > 0, first, 2) for first, g in ((0, in_a), (1, in_b))]
        codes = np.concatenate((sep[0] * self.size + flat_a, sep[1] * self.size + flat_b))
        order = np.argsort(np.concatenate((in_a * 2, in_b * 2 + 1)), kind="stable")
        said = list(map(self.said.__getitem__, codes[order].tolist()))
        at = 0
        for k, counts in enumerate(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True)):
            size = counts[0] + counts[1]
            yield "".join(said[at : at + size])[1:], counts, pairs[to[k] - counts[3] : to[k]]
            at += size


_LOADED: dict[str, Pair] = {}


def _pair(folder: str) -> Pair:
    if folder not in _LOADED:
        _LOADED[folder] = Pair(folder)
    return _LOADED[folder]


def _bytes(text: str | None) -> bool:
    """Whether there is a text and UTF-8 has it (half a surrogate pair has no bytes)."""
    try:
        return bool(text and text.encode())
    except UnicodeEncodeError:
        return False


def encode_texts(texts: list[str | None], pair: Pair) -> Iterator[tuple[tuple[int, ...], str, list[int]]]:
    """Of each text: COUNTS, the groups as a string, and the numbers of its pieces; zeros and nothing for a text without tokens."""
    cut = [pair.pieces(t) if _bytes(t) else [] for t in texts]
    if new := list(dict.fromkeys(p for pieces in cut for p in pieces if p not in pair.ids)):
        pair.learn(new)
    for pieces in cut:
        ids = [pair.ids[p] for p in pieces]
        counts = [pair.counts[k] for k in ids]
        if counts and all(counts):
            yield tuple(map(sum, zip(*counts, strict=True))), ";".join([pair.groups[k] for k in ids]), ids
        else:
            yield (0, 0, 0, 0), "", []


def _planes(x: np.ndarray) -> bytes:
    """The array in the narrowest type that holds it, its bytes sorted by place: a width, then the planes."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 as one zstd frame."""
    parts = [len(x).to_bytes(8, "little") + _planes(x) for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _load(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        planes = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 9 + n * width
    return out


def _order(size: int, radix: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each B id when sorted by radix partition, then id; first place of each partition."""
    ids = np.arange(size)
    by = np.lexsort((ids, ids % radix))
    place = np.empty(size, np.int64)
    place[by] = ids
    return place, np.searchsorted((ids % radix)[by], np.arange(radix + 1))


class Run:
    """Pair-document records of the documents of a task since the last run."""

    def __init__(self, pair: Pair, radix: int):
        self.pair, self.radix = pair, radix
        self.place, self.firsts = _order(pair.size_b, radix)
        self.docs: list[np.ndarray] = []
        self.n_docs = self.records = 0

    def add(self, ids: list[int]) -> None:
        times = Counter(ids)
        self.docs.append(np.array([list(times), list(times.values())], np.int64).reshape(2, -1))
        self.records += sum(self.pair.counts[k][3] for k in times)
        self.n_docs += 1

    def blobs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Partition, index and records of each partition that has any."""
        if not self.records:
            return
        sizes = [d.shape[1] for d in self.docs]
        ids, times = np.concatenate(self.docs, 1)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        known, ids = np.unique(ids, return_inverse=True)
        links = [self.pair.pairs[k] for k in known.tolist()]
        n = np.array([len(x) for x in links])
        flat, at = np.concatenate(links), np.concatenate(([0], np.cumsum(n)))
        n = n[ids]
        pick = np.repeat(at[:-1][ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
        side, a = self.place[flat >> 32], flat & 0xFFFFFFFF
        bits_a = self.pair.size_a.bit_length()
        key = (side << bits_a | a)[pick] << DOC_BITS | np.repeat(doc, n)
        times = np.repeat(times, n)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, times = key[starts], np.add.reduceat(times, starts)
        pairs, doc = key >> DOC_BITS, key & ((1 << DOC_BITS) - 1)
        cuts = np.searchsorted(pairs, self.firsts << bits_a)
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            x = slice(cuts[p], cuts[p + 1])
            new = np.flatnonzero(np.concatenate(([True], pairs[x][1:] != pairs[x][:-1])))
            lengths = np.diff(np.concatenate((new, [cuts[p + 1] - cuts[p]])))
            index = _dump(np.diff(pairs[x][new], prepend=0), np.add.reduceat(times[x], new))
            yield p, index, _dump(lengths, doc[x], times[x])


def _by_chars(batch: pa.RecordBatch, chars: int = 300_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    group = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in pairwise(cuts):
        if b > a:
            yield batch.slice(a, b - a)


def _schema(kind: str) -> str:
    return f"run bigint, part int, place int, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, records binary"


def encode(docs: DataFrame, doc_id: str, text: str, radix: int, folder: str, run_records: int) -> DataFrame:
    """A row per document (part -1), and the blobs of every run."""
    kind = dict(docs.dtypes)[doc_id]
    names = [x.split()[0] for x in _schema("x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, number = _pair(folder), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        pair.forget()
        own, rows, schema = Run(pair, radix), [], None

        def doc_rows() -> pa.RecordBatch:
            fixed = [pa.array(x) for x in zip(*rows, strict=True)]
            n = len(rows)
            columns = [fixed[0], pa.array([-1] * n, pa.int32()), fixed[1].cast(pa.int32()), pa.array(fixed[2].to_pylist(), schema), *[x.cast(pa.int64()) for x in fixed[3:7]], fixed[7].cast(pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def blob_rows() -> Iterator[pa.RecordBatch]:
            for p, index, records in own.blobs():
                empty = [pa.nulls(1, pa.int32()), pa.nulls(1, schema), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([p], pa.int32()), *empty, pa.array([index]), pa.array([records])], names=names)

        for batch in batches:
            schema = batch.column(0).type
            for part in _by_chars(batch):
                doc_ids = part.column(0).to_pylist()
                for i, (counts, groups, ids) in zip(doc_ids, encode_texts(part.column(1).to_pylist(), pair), strict=True):
                    rows.append((number, own.n_docs, i, *counts, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
                    own.add(ids)
                    if own.records >= run_records or own.n_docs >= 1 << DOC_BITS or len(rows) >= 4096:
                        yield doc_rows()
                    if own.records >= run_records or own.n_docs >= 1 << DOC_BITS:
                        yield from blob_rows()
                        own, number = Run(pair, radix), number + 1
                if len(pair.groups) > REMEMBERED[0] or pair.chars > REMEMBERED[1]:
                    if rows:
                        yield doc_rows()
                    yield from blob_rows()
                    own, number = Run(pair, radix), number + 1
                    pair.forget()
        if rows:
            yield doc_rows()
        yield from blob_rows()
        pair.forget()

    return mapped(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), run, _schema(kind))


def merge_counts(streams: list[Iterator[int]], bits_a: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """K-way merge of ascending ``pair << 33 | links`` streams: pairs, their links in all streams, and whether that is the
    most of their side; in order, in blocks that end where a side ends."""
    keys: list[int] = []
    totals: list[int] = []
    mask, last = (1 << 33) - 1, -1

    def finished() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, n = np.array(keys, np.int64), np.array(totals, np.int64)
        new = np.concatenate(([True], pairs[1:] >> bits_a != pairs[:-1] >> bits_a))
        most = np.maximum.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1]
        return pairs, n, n == most

    for x in heapq.merge(*streams):
        pair = x >> 33
        if pair == last:
            totals[-1] += x & mask
            continue
        if len(keys) >= block and pair >> bits_a != last >> bits_a:
            yield finished()
            keys, totals = [], []
        keys.append(pair)
        totals.append(x & mask)
        last = pair
    if keys:
        yield finished()


def _chunks(packed: np.ndarray) -> Iterator[int]:
    for k in range(0, len(packed), 8192):
        yield from packed[k : k + 8192].tolist()


def _answers(part: int, runs: list[tuple[int, bytes]], bits_a: int) -> Iterator[tuple[int, int, bytes]]:
    held = []
    for run, blob in runs:
        steps, n = _load(blob)
        held.append((run, np.cumsum(steps), n))
    said: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in held]
    done = [0] * len(held)
    for pairs, n, best in merge_counts([_chunks(p.astype(np.uint64) << np.uint64(33) | c.astype(np.uint64)) for _, p, c in held], bits_a):
        for k, (_, own, _) in enumerate(held):
            end = int(np.searchsorted(own, pairs[-1], "right"))
            at = np.searchsorted(pairs, own[done[k] : end])
            said[k].append((n[at], best[at].astype(np.int64)))
            done[k] = end
    for (run, _, _), x in zip(held, said, strict=True):
        yield run, part, _dump(np.concatenate([n for n, _ in x]), np.concatenate([b for _, b in x]))


def count(runs: DataFrame, partitions: int, bits_a: int) -> DataFrame:
    """For every run and radix partition: links in the corpus of the pairs of its index, and whether they are strong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, r, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and held:
                    yield from _answer_rows(_answers(part, held, bits_a))
                    held = []
                part = p
                held.append((r, blob))
        if held:
            yield from _answer_rows(_answers(part, held, bits_a))

    dealt = runs.select("part", "run", "links").repartition(partitions, "part").sortWithinPartitions("part", "run")
    return mapped(dealt, run, "run bigint, part int, answer binary")


def _answer_rows(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for r, p, blob in rows:
        yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([p], pa.int32()), pa.array([blob])], names=["run", "part", "answer"])


class Sums:
    """Of the documents of one run: strong links, and the corpus counts of all links."""

    def __init__(self):
        self.best, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, records: bytes, answer: bytes) -> None:
        lengths, doc, times = _load(records)
        n, best = _load(answer)
        size = int(doc.max()) + 1
        if size > len(self.best):
            self.best, self.total = np.pad(self.best, (0, size - len(self.best))), np.pad(self.total, (0, size - len(self.total)))
        np.add.at(self.best, doc, times * np.repeat(best, lengths))
        np.add.at(self.total, doc, times * np.repeat(n, lengths))


def contributions(runs: DataFrame, answers: DataFrame, partitions: int) -> DataFrame:
    """Strong links and summed counts of every document (by run and place) that has links."""
    both = runs.select("run", "part", "records", F.lit(None).cast("binary").alias("answer")).unionByName(answers.select("run", "part", F.lit(None).cast("binary").alias("records"), "answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums, half = None, Sums(), None

        def result() -> pa.RecordBatch:
            at = np.flatnonzero(sums.total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), current)), pa.array(at.astype(np.int32)), pa.array(sums.best[at]), pa.array(sums.total[at])], names=["run", "place", "n_best", "count_sum"])

        for batch in batches:
            for r, _, records, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != current:
                    if current is not None:
                        yield result()
                    current, sums = r, Sums()
                if half is None:
                    half = (records, answer)
                else:
                    sums.add(records or half[0], answer or half[1])
                    half = None
        if current is not None:
            yield result()

    dealt = both.repartition(partitions, "run").sortWithinPartitions("run", "part")
    return mapped(dealt, run, "run bigint, place int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radix: int | None = None, folder: str = TOKENIZERS, run_records: int = RUN_RECORDS) -> DataFrame:
    """Per row of ``docs``: its id, COUNTS, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    spark = docs.sparkSession
    partitions = partitions_for(spark)
    pair = _pair(folder)
    bits_a = pair.size_a.bit_length()
    scratch = Scratch(spark, "alignment")
    table = scratch.save(encode(docs, doc_id, text, radix or partitions, folder, run_records), "runs")
    runs = table.where("part >= 0")
    answers = scratch.save(count(runs, partitions, bits_a), "answers")
    sums = contributions(runs, answers, partitions)
    rows = table.where("part < 0").select("run", "place", F.col("id").alias(doc_id), *COUNTS, "groups_sha256")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.join(sums, ["run", "place"], "left").select(doc_id, *COUNTS, *zero, "groups_sha256")
