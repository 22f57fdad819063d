"""Benchmark decontamination with suffix arrays over the training documents.

Every task gathers whole documents into shards of bounded size, builds a word-level suffix array of each shard
(prefix doubling on tied suffixes only) and binary-searches every suffix of every benchmark item in it. A suffix whose
first ``window`` words occur marks those words in all documents of the shard where they occur. The places that the
benchmark's suffixes would take in the array put both kinds of suffixes in one order, in which the longest match of a
document's suffix is with one of its two neighbours of the other kind; so every affected document gets its longest
verbatim match and where that is. Shards are independent and documents are never split, so nothing is shuffled.

The benchmark reaches the tasks in blocks of at most ``block_bytes`` of text each (one broadcast per block; a single
longer item is a block of its own), and a task holds one block at a time; a larger benchmark means more blocks, never
a larger one.

Edge cases: a null or empty text has no words (all counts 0, not contaminated); a null doc_id is a row like any other;
items without words and items with a null id are ignored; repeated item rows count once per id; an item shorter than
the window is one window as a whole; further columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.kernels import Words, blocks, column_bytes
from folioforge.llm.storage import mapped, same_row

WINDOW = 13
MIN_PERCENT = 5


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = column_bytes(texts)
    parts = [Words(raw[off[a] : off[b]], off[a : b + 1] - off[a], "alnum") for a, b in blocks(off)]
    hashes = np.concatenate([w.hash for w in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([w.counts for w in parts]) if parts else np.zeros(0, np.int64)
    return hashes, counts


class Suffixes:
    """Word suffix array of one shard, sorted by the first ``depth`` words at least."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, depth: int):
        docs = len(counts)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.doc_first = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]  # a separator 0 follows each document
        self.text = np.zeros(len(hashes) + docs, np.int64)
        place = np.arange(len(hashes)) + np.repeat(np.arange(docs), counts)
        self.text[place] = 2 * ids + 2  # even; odd values are words that only the benchmark has
        self.doc_end = self.doc_first + counts
        self.order = self._sorted(place, ids.astype(np.int64) + 1, depth)

    def _sorted(self, place: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
        n = len(self.text)
        if not len(place):
            return place
        plain = np.zeros(n + 1, np.int64)
        plain[place] = ids
        bits = max(1, int(len(self.vocabulary)).bit_length())
        k = min(3, 62 // bits)
        key, alive = plain[:n].copy(), plain[:n] > 0
        for j in range(1, k):
            nxt = np.zeros(n, np.int64)
            nxt[: n - j] = plain[j:n]
            alive = alive & (nxt > 0)
            key = (key << bits) | np.where(alive, nxt, 0)
        order = place[np.argsort(key[place], kind="stable")]
        rank = np.zeros(n + 1, np.int64)
        sorted_keys = key[order]
        new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
        limit, h = np.repeat(self.doc_end, np.diff(np.concatenate((self.doc_first, [n])))), k
        tied = self._tied(new)
        while len(tied) and h < depth:
            at = order[tied]
            ahead = at + h
            follow = np.where(ahead < limit[at], rank[np.minimum(ahead, n)], 0)
            group = rank[at]
            by = np.lexsort((follow, group))
            order[tied] = at[by]
            group, follow = group[by], follow[by]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
            rank[order[tied]] = (tied[new] + 1)[np.cumsum(new) - 1]
            tied = tied[self._tied(new)]
            h *= 2
        return order

    @staticmethod
    def _tied(new: np.ndarray) -> np.ndarray:
        last = np.concatenate((new[1:], [True]))
        return np.flatnonzero(~(new & last))

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Words of the benchmark in this shard's order; words that it lacks fall between its own."""
        at = np.searchsorted(self.vocabulary, hashes)
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes
        return np.where(known, 2 * at + 2, 2 * at + 1)

    def compare(self, suffix: np.ndarray, start: np.ndarray, length: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of (text from ``suffix``) - (pattern from ``start``) over ``length`` words, and the words they share."""
        sign, shared = np.zeros(len(suffix), np.int64), np.zeros(len(suffix), np.int64)
        live, d = np.flatnonzero(length > 0), 0
        while len(live):
            inside = suffix[live] + d < len(self.text)
            t = np.where(inside, self.text[np.minimum(suffix[live] + d, len(self.text) - 1)], 0)
            p = pattern[start[live] + d]
            sign[live] = np.sign(t - p)
            live = live[t == p]
            shared[live] += 1
            d += 1
            live = live[length[live] > d]
        return sign, shared

    def bound(self, start: np.ndarray, length: np.ndarray, pattern: np.ndarray, upper: bool) -> np.ndarray:
        """First place in the array whose suffix is not below (``upper``: is above) the pattern's first ``length`` words."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            sign, _ = self.compare(self.order[mid], start[open_], length[open_], pattern)
            right = sign <= 0 if upper else sign < 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]


class Block:
    """Words of some benchmark items, end to end, and the length left in the item at each."""

    def __init__(self, ids: list[str], hashes: np.ndarray, counts: np.ndarray, window: int):
        self.ids, self.hashes = ids, hashes
        self.item = np.repeat(np.arange(len(ids)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        size = np.repeat(counts, counts)
        at = np.arange(len(hashes))
        self.left = first + size - at
        self.windows = np.flatnonzero((self.left >= window) | ((size < window) & (at == first)))
        self.window_words = np.minimum(size, window)[self.windows]
        self.longest = int(counts.max()) if len(counts) else 0
        self.window, self.whole = window, size < window
        self.place = at - first  # in the item
        order = Suffixes(hashes, counts, self.longest).order
        self.sorted = order - (np.searchsorted(np.cumsum(counts + 1), order, "right"))  # without the separators


def _longest(shard: Suffixes, block: Block, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every suffix of the shard that shares a window or more with the benchmark: its start, the words shared, and where in the block."""
    places = shard.bound(block.sorted, block.left[block.sorted], pattern, False)
    after = np.searchsorted(places, np.arange(len(shard.order)), "right")
    starts, lengths, wheres = [], [], []
    for shift in (-1, 0):  # the neighbours below and above
        k = after + shift
        ok = (k >= 0) & (k < len(block.sorted))
        at, where = shard.order[ok], block.sorted[k[ok]]
        _, shared = shard.compare(at, where, block.left[where], pattern)
        keep = shared >= block.window
        starts.append(at[keep])
        lengths.append(shared[keep])
        wheres.append(where[keep])
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(wheres)


def _search(shard: Suffixes, block: Block, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks covered words; returns distinct (document, item) hits and per-document longest matches as (length, place, item, place in the item)."""
    pattern = shard.encode(block.hashes)
    docs = len(shard.doc_first)
    best = np.zeros((docs, 4), np.int64)
    none = np.zeros(0, np.int64)
    if not len(shard.order) or not len(pattern):
        return none, none, best
    w, m = block.windows, block.window_words
    lo, hi = shard.bound(w, m, pattern, False), shard.bound(w, m, pattern, True)
    found = np.flatnonzero(hi > lo)
    hit_docs, hit_items = [], []
    matches = [_longest(shard, block, pattern)] if len(found) else []
    total = np.cumsum(hi[found] - lo[found])
    for part in np.split(found, np.searchsorted(total, np.arange(1_000_000, int(total[-1]) if len(total) else 0, 1_000_000))):
        n = hi[part] - lo[part]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = shard.order[np.repeat(lo[part], n) + inner]
        length, where = np.repeat(m[part], n), np.repeat(w[part], n)
        covered += np.bincount(at, minlength=len(covered))
        covered -= np.bincount(at + length, minlength=len(covered))
        whole = block.whole[where]
        matches.append((at[whole], length[whole], where[whole]))
        pair = np.unique((np.searchsorted(shard.doc_first, at, "right") - 1) * len(block.ids) + block.item[where])
        hit_docs.append(pair // len(block.ids))
        hit_items.append(pair % len(block.ids))
    if matches:
        at, length, where = (np.concatenate(x) for x in zip(*matches, strict=True))
        doc = np.searchsorted(shard.doc_first, at, "right") - 1
        order = np.lexsort((where, at, -length, doc))
        first = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))] if len(order) else order
        best[doc[first]] = np.stack((length[first], (at - shard.doc_first[doc])[first], block.item[where[first]], block.place[where[first]]), 1)
    return np.concatenate(hit_docs or [none]), np.concatenate(hit_items or [none]), best


RESULT = (
    ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean"),
    ("longest_match", "bigint"), ("longest_at", "bigint"), ("longest_item", "string"), ("longest_item_at", "bigint"),
)


def _judge(texts: pa.Array, load, depth: int, min_percent: int) -> list[pa.Array]:
    """Columns of ``RESULT`` for the texts of one shard."""
    hashes, counts = _word_hashes(texts)
    n = len(counts)
    shard, items = Suffixes(hashes, counts, depth), [set() for _ in range(n)]
    longest: list[tuple] = [(0, None, None, None)] * n
    covered = np.zeros(len(hashes) + n + 1, np.int64)
    for block in load():
        docs, hit, best = _search(shard, block, covered)
        for d, i in zip(docs.tolist(), hit.tolist(), strict=True):
            items[d].add(block.ids[i])
        for d in np.flatnonzero(best[:, 0]).tolist():
            length, place, item, inside = best[d].tolist()
            if length > longest[d][0] or (length == longest[d][0] and place < longest[d][1]):
                longest[d] = (length, place, block.ids[item], inside)
    hits = np.cumsum(covered)[:-1] > 0
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    total = np.concatenate(([0], np.cumsum(hits)))
    n_hit = total[first[1:]] - total[first[:-1]]
    shas = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    found = [pa.array([x[k] for x in longest], pa.string() if k == 2 else pa.int64()) for k in range(4)]
    return [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas, pa.string()), pa.array((n_hit > 0) & (100 * n_hit >= min_percent * counts)), *found]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int) -> tuple[list, int]:
    """The benchmark as broadcast blocks, read one after another, and the words of its longest item."""
    held, ids, texts, size, longest = [], [], [], 0, window

    def flush() -> None:
        nonlocal ids, texts, size, longest
        hashes, counts = _word_hashes(pa.array(texts, pa.string()))
        keep = counts > 0
        block = Block([x for x, k in zip(ids, keep.tolist(), strict=True) if k], hashes, counts[keep], window)
        longest = max(longest, block.longest)
        held.append(benchmark.sparkSession.sparkContext.broadcast(block))
        ids, texts, size = [], [], 0

    distinct = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    for row in distinct.orderBy("i", "t").toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
        if size >= block_bytes:
            flush()
    flush()
    return held, longest


def _judged(docs: DataFrame, keys: list[str], text: str, benchmark: DataFrame, item_id: str, item_text: str, window: int, min_percent: int, shard_bytes: int, block_bytes: int) -> DataFrame:
    """``keys`` and the columns of ``RESULT`` of every row."""
    held, depth = _blocks(benchmark, item_id, item_text, window, block_bytes)

    def load() -> Iterator[Block]:
        for b in held:
            yield b.value
            if len(held) > 1:
                b.__dict__.pop("_value", None)  # one block in memory at a time; read again from local disk for the next shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        waiting, held_bytes = [], 0

        def judged() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            own = [table.column(i).combine_chunks() for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*own, *_judge(table.column(len(keys)).combine_chunks(), load, depth, min_percent)], names=[*keys, *(c for c, _ in RESULT)])

        for batch in batches:
            _, off = column_bytes(batch.column(len(keys)))
            for a, b in blocks(off, shard_bytes):
                waiting.append(batch.slice(a, b - a))
                held_bytes += int(off[b] - off[a])
                if held_bytes >= shard_bytes // 2:
                    yield judged()
                    waiting, held_bytes = [], 0
        if waiting:
            yield judged()

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} {t}" for c, t in RESULT)])
    return mapped(docs.select(*keys, text), run, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, min_percent: int = MIN_PERCENT, shard_bytes: int = 8 << 20, block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document: words, words inside verbatim windows, items hit, the verdict, and the longest match.

    ``contaminated``: some word is hit and hit words are at least ``min_percent`` percent of all. The longest verbatim
    match that holds a window has ``longest_match`` words (0 if there is none), begins at word ``longest_at`` of the
    document (the first such place) and at word ``longest_item_at`` of ``longest_item`` (one of the items that hold it).
    """
    return _judged(docs, [doc_id], text, benchmark, item_id, item_text, window, min_percent, shard_bytes, block_bytes)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, min_percent: int = MIN_PERCENT, shard_bytes: int = 8 << 20, block_bytes: int = 8 << 20,
) -> DataFrame:
    """The rows that are not contaminated, with all their columns. A row is known by its id, null included, and a hash of its text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    bad = _judged(rows, ["doc_id", "row"], "text", benchmark, item_id, item_text, window, min_percent, shard_bytes, block_bytes)
    bad = bad.where("contaminated").select("doc_id", "row")
    whole = docs.select(F.struct("*").alias("all"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("row")).alias("x")
    return whole.join(bad.alias("y"), same_row("id", "row"), "left_anti").select("all.*")
