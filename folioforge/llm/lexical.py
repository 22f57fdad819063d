"""Ranked lexical search over K2-treaps of the term-document grid.

A K2-treap is a quadtree over a grid whose cells hold numbers: a node has a child for each quadrant with cells, and the
most that its cells hold. Here rows are terms, columns are documents, and a cell is the impact of the term in the
document, so a node bounds what a range of documents can gain from a range of terms.

1. One pass counts documents and terms (impacts depend on both totals).
2. One pass builds treaps, each over the documents that a task reads until it has ``cells`` of them: a bit map of the
   children of each node and, for each node, how much its parent's maximum exceeds its own; rows are numbered in order of
   first appearance, so frequent terms share nodes. A treap is a row of the index, its terms are further rows (term, row,
   documents that hold it). Nothing is shuffled, every document and term is indexed, and the index is a table.
3. Items' terms meet the index's terms in a join, which also gives document frequencies and so the terms' weights. Each
   treap gets the rows of the items' terms that it has, in blocks of items (``block_terms`` rows at most, or one item).
4. In a treap an item descends with all its rows at once over document ranges, the range of greatest bound first: a range
   halves, each row's path goes to the child of its half, and the bound is the weighted sum of the paths' maxima. At a
   single document the bound is its score. Ranges that cannot reach the item's ``k`` best so far (in all treaps of this
   task) are left out. The best of all tasks are ranked by a window.

All bounds are integers, so results are exact and do not depend on how documents fall into treaps. Memory of a task
follows ``cells`` and ``block_terms``, and one document at least.

Edge cases: null and wordless texts are in no treap and no average; items without terms, or with terms in no document,
have no rows; equal items (id and text) are one item, items that share an id are ranked apart under that id; rows that
repeat a document id are documents of their own (equal scores of equal ids get different ranks); further columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.storage import Scratch, mapped, partitions_for

K = 10
CELLS = 1_500_000  # of a treap
BLOCK_TERMS = 200_000  # rows of items' terms that search a treap together
STEP = 32  # ranges that are halved at once

# Bytes that are not part of a term become spaces; terms are then what spaces part.
_TERMS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Of terms with ``tf`` occurrences in documents of ``n`` terms."""
    m = 100 - 90 + (90 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * df + 1)))


class Treap:
    """Cells sorted along the quadtree's order, and its levels from the root: children of each node, and maxima."""

    def __init__(self, depth: int, children: list[np.ndarray], maxima: list[np.ndarray]):
        self.depth = depth
        sizes = np.cumsum([0, *map(len, maxima)])
        self.children = np.concatenate([*children, np.zeros(len(maxima[-1]), np.uint8)])
        self.maxima = np.concatenate(maxima)
        self.first = np.cumsum(_SIZE[self.children]) - _SIZE[self.children] + 1  # nodes are numbered level by level, so children follow in order
        self.first[sizes[-2] :] = 0

    def child(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Children of nodes, -1 where there is none (or no node)."""
        has = self.children[node]
        held = (has >> quadrant & 1).astype(bool) & (node >= 0)
        return np.where(held, self.first[node] + _SIZE[has & ((1 << quadrant) - 1)], -1)


_SIZE = np.array([bin(x).count("1") for x in range(16)], np.int64)


def build(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """Depth, children and maxima of a treap over cells with values of 1 or more."""
    depth = max(1, int(max(row.max(), column.max())).bit_length())
    key = np.zeros(len(row), np.int64)
    for b in range(depth):
        key |= (row >> b & 1) << 2 * b + 1 | (column >> b & 1) << 2 * b
    order = np.argsort(key)
    key, maxima, children = key[order], [value[order].astype(np.int64)], []
    for _ in range(depth):
        parent = key >> 2
        new = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        children.append(np.bitwise_or.reduceat(np.left_shift(1, key & 3).astype(np.uint8), new))
        maxima.append(np.maximum.reduceat(maxima[-1], new))
        key = parent[new]
    return depth, children[::-1], maxima[::-1]


def dump(depth: int, children: list[np.ndarray], maxima: list[np.ndarray], ids: pa.Array) -> bytes:
    """One zstd frame: sizes of the levels, children, what each node's maximum is short of its parent's, and document ids."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
        w.write_batch(pa.record_batch([ids], names=["id"]))
    held = sink.getvalue().to_pybytes()
    short = [maxima[0]] + [np.repeat(maxima[k], _SIZE[children[k]]) - maxima[k + 1] for k in range(depth)]
    flat = np.concatenate(short).astype("<u4")
    head = np.array([depth, *map(len, maxima)], "<i8")
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(b"".join((head.tobytes(), np.concatenate(children).tobytes(), planes.tobytes(), held)))


def load(blob: bytes) -> tuple[Treap, pa.Array]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    depth = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", depth + 1, 8)
    at, nodes = 8 * (depth + 2), int(sizes.sum())
    inner = nodes - int(sizes[-1])
    children = np.split(np.frombuffer(raw, np.uint8, inner, at), np.cumsum(sizes[:-1])[:-1])
    short = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * nodes, at + inner).reshape(4, nodes).T).view("<u4").ravel().astype(np.int64)
    short = np.split(short, np.cumsum(sizes)[:-1])
    maxima = [short[0]]
    for k in range(depth):
        maxima.append(np.repeat(maxima[k], _SIZE[children[k]]) - short[k + 1])
    ids = pa.ipc.open_stream(pa.BufferReader(raw[at + inner + 4 * nodes :])).read_all().column(0).combine_chunks()
    return Treap(depth, children, maxima), ids


def descend(treap: Treap, rows: np.ndarray, weights: np.ndarray, best: list[int], k: int) -> Iterator[tuple[int, int]]:
    """Columns and scores that may be among the ``k`` greatest, greatest bound first. ``best``: a heap of the greatest scores
    known so far, which is added to; columns with less than its least are left out once it has ``k``."""

    def bound(nodes: np.ndarray) -> np.ndarray:
        return (np.where(nodes >= 0, treap.maxima[nodes], 0) * weights).sum(1)

    root = np.zeros((1, len(rows)), np.int64)
    waiting = [(-int(bound(root)[0]), 0, 0, root[0])]  # bound, first column, level, nodes of the rows' paths
    while waiting:
        taken = []
        while waiting and len(taken) < STEP and (len(best) < k or -waiting[0][0] >= best[0]):
            taken.append(heapq.heappop(waiting))
        if not taken:
            return
        level, first = np.array([t[2] for t in taken]), np.array([t[1] for t in taken])
        nodes = np.stack([t[3] for t in taken])
        shift = treap.depth - 1 - level
        down = (rows[None, :] >> shift[:, None] & 1) * 2
        for half in (0, 1):
            into = treap.child(nodes, down + half)
            gain = bound(into)
            for j in np.flatnonzero(gain > 0).tolist():
                column, score = int(first[j] * 2 + half), int(gain[j])
                if len(best) >= k and score < best[0]:
                    continue
                if shift[j] == 0:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, score)
                    yield column, score
                else:
                    heapq.heappush(waiting, (-score, column, int(level[j]) + 1, into[j]))


def totals(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        for batch in batches:
            for t in pc.cast(batch.column(0), pa.large_binary()):
                n = len(terms(t.as_py() or b""))
                documents, total = documents + (n > 0), total + n
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["documents", "total"])

    row = mapped(docs.select(text), run, "documents bigint, total bigint").agg(F.sum("documents"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def index(docs: DataFrame, documents: int, total: int, doc_id: str, text: str, cells: int) -> DataFrame:
    """Treaps (``treap``), and their terms with row and document frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        vocabulary: dict[bytes, int] = {}
        rows, times, sizes, ids, held, kind = [], [], [], [], 0, None

        def finished() -> Iterator[pa.RecordBatch]:
            row = np.concatenate(rows)
            column = np.repeat(np.arange(len(rows)), list(map(len, rows)))
            value = impact(np.concatenate(times), np.array(sizes)[column], documents, total)
            blob = dump(*build(row, column, value), pa.array(ids, kind))
            names = ["shard", "term", "row", "df", "treap"]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob])], names=names)
            frequency, words = np.bincount(row, minlength=len(vocabulary)), list(vocabulary)
            for a in range(0, len(words), 50_000):
                part = pa.array(words[a : a + 50_000], pa.binary()).cast(pa.string())
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), part, pa.array(np.arange(a, a + n)), pa.array(frequency[a : a + n]), pa.nulls(n, pa.binary())], names=names)

        for batch in batches:
            kind = batch.column(0).type
            doc_ids = batch.column(0).to_pylist()
            for i, t in zip(doc_ids, pc.cast(batch.column(1), pa.large_binary()), strict=True):
                found = Counter(terms(t.as_py() or b""))
                if not found:
                    continue
                rows.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found]))
                times.append(np.array(list(found.values())))
                sizes.append(int(times[-1].sum()))
                ids.append(i)
                held += len(found)
                if held >= cells:
                    yield from finished()
                    number, held = number + 1, 0
                    vocabulary.clear()
                    for x in (rows, times, sizes, ids):
                        x.clear()
        if rows:
            yield from finished()

    return mapped(docs.select(doc_id, text), run, "shard bigint, term string, row bigint, df bigint, treap binary")


def items_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """A row for each item and each of its terms; ``item`` tells items apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0), pc.cast(batch.column(1), pa.large_binary()), strict=True):
                found = pa.array(sorted(set(terms(t.as_py() or b""))), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(i, len(found)), found], names=["item", "term"])

    one = items.select(F.struct(F.col(item_id).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("text")).alias("item"), F.col(text).alias("text")).dropDuplicates(["item"])
    keyed = one.select(F.to_json("item", {"ignoreNullFields": "false"}).alias("item"), "text")
    ids = one.select(F.to_json("item", {"ignoreNullFields": "false"}).alias("item"), F.col("item.id").alias("item_id"))
    return mapped(keyed, run, "item string, term string").join(ids, "item")


def search(index: DataFrame, asked: DataFrame, documents: int, k: int, block_terms: int, partitions: int, id_kind: str) -> DataFrame:
    """The ``k`` best documents of each item: item, doc_id, score, rank. ``asked``: rows (item, term)."""
    known = index.where("term is not null").select("term", "shard", "row", "df")
    met = asked.select("item", "term").join(known, "term")
    df = met.dropDuplicates(["term", "shard"]).groupBy("term").agg(F.sum("df").alias("df"))
    weighted = df.select("term", weight(F.col("df"), documents).alias("weight")).where("weight > 0")
    rows = met.select("item", "term", "shard", "row").join(weighted, "term")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    per_item = rows.groupBy("shard", "item").agg(F.collect_list(F.struct("row", "weight")).alias("paths"))
    queries = per_item.groupBy("shard", block.alias("block")).agg(F.collect_list(F.struct("item", "paths")).alias("queries"))
    work = index.where("term is null").select("shard", "treap").join(queries, "shard").repartition(partitions, "shard", "block").sortWithinPartitions("block", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[int]] = {}
        last = None
        for batch in batches:
            for j in range(batch.num_rows):
                if batch.column(1)[j].as_py() != last:
                    best, last = {}, batch.column(1)[j].as_py()
                treap, ids = load(batch.column(2)[j].as_py())
                for q in batch.column(3)[j].as_py():
                    rows, weights = np.array([(p["row"], p["weight"]) for p in q["paths"]], np.int64).reshape(-1, 2).T
                    heap = best.setdefault(q["item"], [])
                    found = [x for x in descend(treap, rows, weights, heap, k)]
                    found = [x for x in found if len(heap) < k or x[1] >= heap[0]]
                    columns = pa.array([c for c, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([q["item"]] * len(found), pa.string()), ids.take(columns), pa.array([s for _, s in found], pa.int64())], names=["item", "doc_id", "score"])

    hits = mapped(work.select("shard", "block", "treap", "queries"), run, f"item string, doc_id {id_kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, cells: int = CELLS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per item its ``k`` best documents: item_id, rank, doc_id, score."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    documents, total = totals(docs, text)
    treaps = scratch.save(index(docs, documents, total, doc_id, text, cells), "index")
    asked = scratch.save(items_terms(items, item_id, item_text), "asked")
    ids = asked.select("item", "item_id").distinct()
    found = search(treaps, asked, documents, k, block_terms, partitions_for(spark), dict(docs.dtypes)[doc_id])
    return found.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(doc_id), "score")
