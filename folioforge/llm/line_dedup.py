"""Fuzzy line deduplication: MinHash over character shingles, exact verification, distributed components.

Lines (text split at newlines) of ``min_chars`` code points or more are judged; shorter ones always stay. The query and
the pipeline judge every line that has a character other than white space (``min_chars=1``); lines of white space are
judged from ``MIN_CHARS`` on only. Lines shorter than a shingle are grouped by equality alone, which is exact. A line's
signature has one minimum for each of ``bands * rows`` bins (one-permutation hashing; an empty bin borrows from a
seeded sequence of other bins), so each shingle is hashed once whatever the signature's length. Two lines of Jaccard
similarity s agree in some band with probability 1 - (1 - s**rows)**bands: 0.995 at 0.75 and above 0.999 at 0.8.
Candidates come from one sorted pass over the bands; a line is first verified against the line that it meets most
often, and then what lies in different components is verified in full, as for near-duplicate documents. Equal lines
are one node from the start. Of each component the line first by (document id, line number) is kept.

A line belongs to a row: the document id (of any orderable type) and a 64-bit hash of the text.

Edge cases: null and empty texts have no judged line; rows without a document id are judged like others (first in
order); rows that repeat an id are told apart by their text; rows that repeat id and text count as one place each and
lose the same lines; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import postings
from folioforge.llm.graph import components
from folioforge.llm.kernels import U64, _powers, blocks, column_bytes, mix, signed
from folioforge.llm.storage import Scratch, mapped, partitions_for, same_row

SHINGLE, PERCENT, MIN_CHARS, BANDS, ROWS = 8, 75, 40, 14, 4
EMPTY = np.uint32(0xFFFFFFFF)
ASKED = 4  # bins that all empty bins ask together; what is empty then asks all full ones at once
ENTRIES = 4_000_000  # band entries of a partition, 16 bytes each
SENT = 1_000_000  # keys a task remembers


class Lines:
    """Judged lines of a block of texts, in code points."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, min_chars: int):
        self.points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]  # in code points
        breaks = np.flatnonzero(self.points == 10)
        nonempty = np.flatnonzero(np.diff(at) > 0)
        begins = np.concatenate((at[:-1][nonempty], breaks + 1))
        doc = np.concatenate((nonempty, np.searchsorted(at, breaks, "right") - 1))
        order = np.lexsort((begins, doc))  # the empty last line of a text and the next text's first line begin at one place
        self.start, self.doc = begins[order], doc[order]
        nxt = np.concatenate((self.start[1:], [len(self.points)]))
        last = np.concatenate((self.doc[1:] != self.doc[:-1], [True])) if len(self.doc) else np.zeros(0, bool)
        self.end = np.where(last, at[self.doc + 1] if len(self.doc) else nxt, nxt - 1)
        first = np.flatnonzero(np.concatenate(([True], self.doc[1:] != self.doc[:-1]))) if len(self.doc) else np.zeros(0, np.int64)
        self.number = np.arange(len(self.start)) - np.repeat(first, np.diff(np.concatenate((first, [len(self.start)]))))
        size = self.end - self.start
        dark = np.concatenate(([0], np.cumsum((self.points != 32) & ((self.points < 9) | (self.points > 13)))))
        keep = (size >= min_chars) & ((size >= MIN_CHARS) | (dark[self.end] > dark[self.start]))
        self.start, self.end, self.doc, self.number = self.start[keep], self.end[keep], self.doc[keep], self.number[keep]
        n = len(self.points)
        p, q = _powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(mix(self.points.astype(U64) + U64(0x632BE59B)) * p[:n], out=total[1:])
        self.total, self.inverse = total, q
        self.key = mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(U64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k-character shingle of the judged lines, line after line, and how many each line has."""
        count = self.end - self.start - k + 1
        at = np.arange(int(count.sum())) + np.repeat(self.start - (np.cumsum(count) - count), count)
        return mix((self.total[at + k] - self.total[at]) * self.inverse[at]), count


@lru_cache(maxsize=4)
def _lenders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bins that each bin asks, attempt by attempt (attempts x bins), and the attempt at which a bin first asks each other one (bins x bins)."""
    col, asked, rank = np.arange(bins, dtype=U64) * U64(1000003), [], np.full((bins, bins), -1, np.int32)
    while (rank < 0).any():
        lender = (mix(col + U64(len(asked) + 1)) % U64(bins)).view(np.int64)
        new = rank[np.arange(bins), lender] < 0
        rank[np.flatnonzero(new), lender[new]] = len(asked)
        asked.append(lender)
    return np.stack(asked[:ASKED]), rank


def signatures(hashes: np.ndarray, count: np.ndarray, bins: int) -> np.ndarray:
    """One minimum for each bin; empty bins borrow from the first full one that they ask."""
    out = np.full((len(count), bins), EMPTY, np.uint32)
    slot = ((hashes >> U64(32)) * U64(bins)) >> U64(32)
    where = np.repeat(np.arange(len(count)) * bins, count) + slot.view(np.int64)
    np.minimum.at(out.reshape(-1), where, (hashes & U64(0xFFFFFFFE)).astype(np.uint32))
    full = out != EMPTY
    row, col = np.nonzero(~full)
    if not len(row):
        return out
    asked, rank = _lenders(bins)
    for lenders in asked:
        lender = lenders[col]
        ok = full[row, lender]
        out[row[ok], col[ok]] = out[row[ok], lender[ok]]
        row, col = row[~ok], col[~ok]
    for lo in range(0, len(row), 1 << 14):  # lines with few full bins: the one asked first
        r, c = row[lo : lo + (1 << 14)], col[lo : lo + (1 << 14)]
        out[r, c] = out[r, np.where(full[r], rank[c], np.int32(1 << 30)).argmin(1)]
    return out


def _bands(docs: DataFrame, k: int, min_chars: int, bands: int, rows: int, partitions: int, flush: int = 1_000_000) -> DataFrame:
    """Band hashes of judged lines with the lines' keys, packed by target partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        tokens, keys, held = [], [], 0
        sent = np.zeros(0, U64)  # keys whose bands this task has sent; forgotten when full, as repeats do no harm
        for batch in batches:
            raw, off = column_bytes(batch.column(0))
            for a, b in blocks(off, 1 << 20):
                lines = Lines(raw[off[a] : off[b]], off[a : b + 1] - off[a], max(k, min_chars))
                if not len(lines.key):
                    continue
                key, one = np.unique(lines.key, return_index=True)
                one = one[~np.isin(key, sent, assume_unique=True)]
                if not len(one):
                    continue
                lines.start, lines.end, lines.key = lines.start[one], lines.end[one], lines.key[one]
                sent = lines.key if len(sent) > SENT else np.concatenate((sent, lines.key))
                sig = signatures(*lines.shingles(k), bands * rows).reshape(-1, bands, rows).astype(U64)
                token = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), sig.shape[:2]).copy()
                for j in range(rows):
                    token = mix(token * U64(0x2545F4914F6CDD1D) + sig[:, :, j])
                tokens.append(token.reshape(-1))
                keys.append(np.repeat(lines.key, bands))
                held += len(keys[-1])
                if held >= flush:
                    yield postings.pack(np.concatenate(tokens), np.concatenate(keys), partitions)
                    tokens, keys, held = [], [], 0
        if held:
            yield postings.pack(np.concatenate(tokens), np.concatenate(keys), partitions)

    return mapped(docs.select("text"), run, "part int, block binary")


def _members(docs: DataFrame, min_chars: int, texts: bool = False) -> DataFrame:
    """doc_id, row, line, key of every judged line; ``texts``: key and text, only of lines whose key is in the row's ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            raw, off = column_bytes(batch.column(2))
            for a, b in blocks(off):
                lines = Lines(raw[off[a] : off[b]], off[a : b + 1] - off[a], min_chars)
                if texts:
                    wanted = [set(x) for x in batch.column(3).slice(a, b - a).to_pylist()]
                    pick = [i for i, (d, x) in enumerate(zip(lines.doc.tolist(), signed(lines.key).tolist(), strict=True)) if x in wanted[d]]
                    found = [lines.points[lines.start[i] : lines.end[i]].tobytes().decode("utf-32-le") for i in pick]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(lines.key)[pick]), pa.array(found, pa.string())], names=["key", "text"])
                else:
                    at = pa.array(lines.doc + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.number.astype(np.int32)), pa.array(signed(lines.key))], names=["doc_id", "row", "line", "key"])

    return mapped(docs, run, "key bigint, text string" if texts else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row bigint, line int, key bigint")


def _shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each line; a line shorter than a shingle has none."""
    raw, off = column_bytes(column)
    out = []
    for a, b in blocks(off):
        lines = Lines(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)
        hashes, count = lines.shingles(k)
        found = [np.zeros(0, U64)] * (b - a)
        for d, x in zip(lines.doc.tolist(), np.split(hashes, np.cumsum(count)[:-1]), strict=True) if len(count) else ():
            found[d] = np.unique(x)
        out += found
    return out


def _rest(mixed: DataFrame) -> DataFrame:
    """All pairs of different labels that agree in a band."""
    a, b = (mixed.select("token", F.col("key").alias(f"key_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    met = a.join(b, "token").where("key_a < key_b and label_a <> label_b")
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def _components(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, min_chars: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row, line, kept_at (doc_id, row, line) of every judged line that has a likeness elsewhere."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "lines"), partitions_for(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    members = scratch.save(_members(docs, min_chars), "members")
    nodes = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "line")).alias("first"))
    parts = max(parts, -(-members.count() * bands // ENTRIES))
    live = scratch.save(postings.shared_packed(_bands(docs, shingle, min_chars, bands, rows, parts), parts), "live")
    nodes = scratch.save(nodes.join(live.select("key").distinct().withColumn("live", F.lit(True)), "key", "left").where("live or n > 1"), "nodes")
    wanted = nodes.where("live").groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row")).agg(F.collect_set("key").alias("wanted"))
    placed = docs.alias("x").join(wanted.alias("y"), same_row("doc_id", "row")).select("x.doc_id", "x.row", "x.text", "y.wanted")
    blobs = scratch.save(_members(placed, min_chars, texts=True).dropDuplicates(["key"]), "blobs")

    def sets(column: pa.Array) -> list[np.ndarray]:
        return _shingle_sets(column, shingle)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among ``pairs``, as a table."""
        found = scratch.save(postings.verified(scratch.save(pairs, f"{name}-pairs"), blobs, sets, percent, partitions_for(spark)), name)
        scratch.drop(f"{name}-pairs")
        return found

    first = postings.best_heads(live).select(F.col("key").alias("a"), F.col("other").alias("b"))
    links = verified(first, "links-1")
    labels = scratch.save(components(links, scratch, "cc1").select(F.col("node").alias("key"), F.col("component").alias("label")), "labels-1")
    mixed = scratch.save(postings.relabelled(live, labels), "mixed-1")
    entries, sizes = postings.split_by_cluster(mixed, live)
    entries, sizes = scratch.save(entries, "entries"), scratch.save(sizes, "clusters")
    scratch.drop("mixed-1")
    scratch.drop("live")
    dense = scratch.save(postings.block_links(entries, sizes, blobs, sets, percent, parts), "links-2")
    links = links.unionByName(dense).unionByName(verified(_rest(entries.where("cluster is null")), "links-3"))
    scratch.drop("entries")
    scratch.drop("blobs")
    labels = components(links, scratch, "cc2").select(F.col("node").alias("key"), F.col("component").alias("label"))

    named = nodes.select("key", "n", "first").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    groups = named.groupBy("label").agg(F.sum("n").alias("lines"), F.min("first").alias("kept_at")).where("lines > 1")
    return members.join(named.join(groups, "label").select("key", "kept_at"), "key").select("doc_id", "row", "line", "kept_at")


def line_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, min_chars: int = MIN_CHARS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Every judged line that has a likeness elsewhere: doc_id, line (from 0), first_doc, first_line of its component, kept."""
    found = _components(docs, doc_id, text, shingle, percent, min_chars, bands, rows)
    here = F.struct("doc_id", "row", "line").eqNullSafe(F.col("kept_at"))
    return found.select("doc_id", "line", F.col("kept_at.doc_id").alias("first_doc"), F.col("kept_at.line").alias("first_line"), here.alias("kept"))


def drop_duplicate_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, min_chars: int = MIN_CHARS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """The documents without the lines that are not kept; a document goes only if nothing but such lines and white space was in it."""
    found = _components(docs, doc_id, text, shingle, percent, min_chars, bands, rows).where(~F.struct("doc_id", "row", "line").eqNullSafe(F.col("kept_at")))
    gone = found.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines"))
    joined = docs.select(F.struct("*").alias("all"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("row")).alias("x").join(gone.alias("y"), same_row("id", "row"), "left")
    body, lines = F.col(f"x.all.`{text}`"), F.col("y.lines")

    def without(parts: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(parts) - 1)
        return F.array_join(F.transform(F.array_except(places, lines), lambda i: F.get(parts, i)), "\n")

    kept = F.get(F.transform(F.array(F.split(body, "\n")), without), F.lit(0))
    joined = joined.select("x.all", lines.alias("lines"), F.when(lines.isNull(), body).otherwise(kept).alias("kept"))
    joined = joined.where(F.col("lines").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*[F.col("kept").alias(c) if c == text else F.col(f"all.`{c}`").alias(c) for c in docs.columns])
