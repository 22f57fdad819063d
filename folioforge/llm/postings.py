"""Shared tokens: which keys meet in a token, found by one sorted pass whose memory does not depend on a token's frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.storage import mapped

LIVE = "token bigint, key bigint, meta bigint, head bigint, head_meta bigint"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, head = None, None  # the last row, which waits for its successor; the first row of its run
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held is not None:
            rows = np.concatenate((held[:, None], rows), 1)
        if not rows.shape[1]:
            continue
        new = np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))
        rows = rows[:, new]
        n = rows.shape[1]
        first = np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))
        begun = np.flatnonzero(first)[np.cumsum(first) - 1]
        heads = rows[:, begun]
        goes_on = held is not None and not (head == held).all()
        if held is not None:
            heads[:, begun == 0] = head[:, None]
        live = ~first | np.concatenate((~first[1:], [False]))
        live[0] |= goes_on
        held, head = rows[:, -1].copy(), heads[:, -1].copy()
        live[-1] = False
        if live.any():
            yield _batch(rows[:, live], heads[:, live])
    if held is not None and not (head == held).all():
        yield _batch(held[:, None], head[:, None])


def _batch(rows: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, heads[1], heads[2])], names=["token", "key", "meta", "head", "head_meta"])


def shared(entries: DataFrame, partitions: int) -> DataFrame:
    """Of ``entries`` (token, key, meta), those whose token occurs with two keys or more, once each, with the token's least key as head."""
    dealt = entries.select("token", "key", "meta").repartition(partitions, "token").sortWithinPartitions("token", "key", "meta")
    return mapped(dealt, _runs, LIVE)


def pack(token: np.ndarray, key: np.ndarray, partitions: int) -> pa.RecordBatch:
    """Entries as one block of bytes per target partition: tokens, then keys."""
    part = ((token >> np.uint64(32)) % np.uint64(partitions)).view(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(partitions + 1))
    found = np.flatnonzero(np.diff(cuts)).tolist()
    blocks = [token[order[cuts[p] : cuts[p + 1]]].tobytes() + key[order[cuts[p] : cuts[p + 1]]].tobytes() for p in found]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])


def shared_packed(blocks: DataFrame, partitions: int) -> DataFrame:
    """As ``shared``, for packed entries (meta is 0): a partition is sorted as arrays in memory, 16 bytes an entry, so ``partitions`` must follow the number of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(p, []).append(np.frombuffer(block.as_buffer(), np.int64).reshape(2, -1))
        for p in list(held):
            rows = np.concatenate(held.pop(p), 1)
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            rows = rows[:, np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))]
            first = np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))
            live = ~first | np.concatenate((~first[1:], [False]))
            heads = rows[1][np.flatnonzero(first)[np.cumsum(first) - 1]]
            none = np.zeros(int(live.sum()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[0, live], rows[1, live], none, heads[live], none)], names=["token", "key", "meta", "head", "head_meta"])

    return mapped(blocks.repartition(partitions, "part"), run, LIVE)


def best_heads(live: DataFrame) -> DataFrame:
    """One pair a key: the head that it meets in most tokens (the lesser on ties)."""
    met = live.where("key <> head").groupBy("key", "head").agg(F.count("*").alias("n"))
    return met.groupBy("key").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("other"))


def relabelled(live: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of tokens that still hold more than one label. ``labels``: key, label; a key without a row is its own label."""
    named = live.select("token", "key", "meta").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    return named.join(mixed, "token", "left_semi")


def second_heads(mixed: DataFrame) -> DataFrame:
    """key, meta, head, head_meta, a row for each token with keys of another label: an end of a reshuffled order that has another label serves as head."""
    order = F.xxhash64("key", F.lit(7))
    ends = mixed.groupBy("token").agg(
        F.min(F.struct(order.alias("o"), "label", "key", "meta")).alias("lo"), F.max(F.struct(order.alias("o"), "label", "key", "meta")).alias("hi"),
        F.min(F.struct("label", order.alias("o"), "key", "meta")).alias("least"), F.max(F.struct("label", order.alias("o"), "key", "meta")).alias("most"),
    )
    other = F.coalesce(*[F.when(F.col(f"{x}.label") != F.col("label"), F.struct(f"{x}.key", f"{x}.meta")) for x in ("lo", "hi", "least", "most")])
    met = mixed.join(ends, "token").select("key", "meta", other.alias("other")).where("other is not null")
    return met.select("key", "meta", F.col("other.key").alias("head"), F.col("other.meta").alias("head_meta"))


BIG, CHUNK, QUERIES = 32, 512, 4096


def verified(pairs: DataFrame, blobs: DataFrame, sets, percent: int, partitions: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sets are similar enough. Texts cross the network twice, once to their key and once to
    the pair's ``b``, whose set is made once for up to ``QUERIES`` of its pairs. ``sets`` as for ``block_links``. ``pairs`` is read twice."""
    salts = F.ceil(F.col("n") / QUERIES).cast("int")
    heads = pairs.groupBy("b").agg(F.count("*").alias("n"))
    asked = pairs.join(heads, "b").select(F.col("a").alias("key"), "b", F.pmod(F.xxhash64("a", F.lit(3)), salts).cast("int").alias("salt"), F.lit(1).alias("side"))
    heads = heads.select(F.col("b").alias("key"), "b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side"))
    rows = asked.unionByName(heads).join(blobs, "key").select("b", "salt", "side", "key", "text")
    dealt = rows.repartition(partitions, "b", "salt").sortWithinPartitions("b", "salt", "side", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        group, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = [c.to_pylist() for c in batch.columns[:4]]
            out: list[tuple[int, int]] = []
            for b, salt, side, key, x in zip(*where, sets(batch.column(4)), strict=True):
                if side == 0:
                    group, head = (b, salt), x
                elif (b, salt) == group:  # without a text of b there is nothing to compare with
                    inter = len(x) + len(head) - len(np.unique(np.concatenate((x, head))))
                    if 100 * inter >= percent * (len(x) + len(head) - inter):
                        out.append((key, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return mapped(dealt, run, "a bigint, b bigint")


def split_by_cluster(mixed: DataFrame, live: DataFrame, big: int = BIG) -> tuple[DataFrame, DataFrame]:
    """Entries with the cluster of their key (the key that it meets most often) where that has ``big`` keys or more, and the sizes of those clusters."""
    heads = best_heads(live).select("key", F.col("other").alias("cluster"))
    keys = mixed.select("key", "label").distinct().join(heads, "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))
    sizes = keys.groupBy("cluster").agg(F.count("*").alias("members")).where(F.col("members") >= big)
    named = keys.join(sizes, "cluster", "left").select("key", F.when(F.col("members").isNotNull(), F.col("cluster")).alias("cluster"), "members")
    return mixed.join(named, "key"), sizes


def block_links(entries: DataFrame, sizes: DataFrame, blobs: DataFrame, sets, percent: int, partitions: int) -> DataFrame:
    """Links (a, b) between keys of big clusters and all keys that share a token with one of their members.

    A key is sent once to each block of a cluster (``CHUNK`` members or so), not once to each member; a block is held
    as an inverted index, every query's intersections with all members are counted at once, and of the links found
    only those are returned that join labels which the block has not joined yet. Nothing is left out: whatever a pair
    shares a token with is compared, and rows grow with keys and blocks, not with pairs. ``sets`` turns a text column
    into sorted distinct hashes of each text.
    """
    inside = entries.where("cluster is not null")
    present = inside.groupBy("token").agg(F.collect_set("cluster").alias("present"))
    touched = entries.select("token", "key").join(present, "token").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("present"))).alias("present"))
    chunks, salts = F.ceil(F.col("members") / CHUNK).cast("int"), F.ceil(F.col("members") / QUERIES).cast("int")
    queries = touched.select("key", F.explode("present").alias("cluster")).join(sizes, "cluster")
    queries = queries.select("key", "cluster", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.pmod(F.xxhash64("key", F.lit(3)), salts).cast("int").alias("salt"), F.lit(1).alias("side"))
    members = inside.select("key", "cluster", "members").distinct()
    members = members.select("key", "cluster", F.pmod(F.xxhash64("key", F.lit(5)), chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side"))
    labels = entries.select("key", "label").distinct()
    known = blobs.join(labels, "key")
    rows = members.unionByName(queries).join(known, "key").select("cluster", "chunk", "salt", "side", "key", "label", "text")
    dealt = rows.repartition(partitions, "cluster", "chunk", "salt").sortWithinPartitions("cluster", "chunk", "salt", "side", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        group, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:6]])
            found = sets(batch.column(6))
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                here = tuple(where[:3, i].tolist())
                if here != group:
                    group, block = here, _Block(percent)
                if where[3, i] == 0:
                    block.add(int(where[4, i]), int(where[5, i]), found[i])
                else:
                    out += block.ask(int(where[4, i]), int(where[5, i]), found[i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return mapped(dealt, run, "a bigint, b bigint")


class _Block:
    """Members of one block as an inverted index, and which labels its links have joined."""

    def __init__(self, percent: int):
        self.percent, self.keys, self.labels, self.sets, self.index, self.parent = percent, [], [], [], None, {}

    def add(self, key: int, label: int, members: np.ndarray) -> None:
        self.keys.append(key)
        self.labels.append(label)
        self.sets.append(members)

    def _find(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def ask(self, key: int, label: int, asked: np.ndarray) -> list[tuple[int, int]]:
        if not self.keys:
            return []
        if self.index is None:
            self.size = np.array([len(s) for s in self.sets])
            flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
            order = np.argsort(flat, kind="stable")
            self.index, self.sets = (flat[order], owner[order]), []
        flat, owner = self.index
        lo, hi = np.searchsorted(flat, asked, "left"), np.searchsorted(flat, asked, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(self.keys))
        out = []
        for i in np.flatnonzero(100 * shared >= self.percent * (self.size + len(asked) - shared)).tolist():
            a, b = self._find(label), self._find(self.labels[i])
            if a != b and self.keys[i] != key:
                self.parent[max(a, b)] = min(a, b)
                out.append((key, self.keys[i]))
        return out
