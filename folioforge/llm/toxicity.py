"""Toxicity severity by cumulative-link ordinal regression on hashed sparse text features.

Features are words and word prefixes (as bytes, ASCII capitals folded), hashed to ``2**bits`` slots, with the value
log(1 + occurrences). One weight vector is shared by all ordered thresholds: P(grade > k) = sigmoid(w.x - theta_k),
theta increasing. The expected severity of a document is the sum of these probabilities.

The model is fitted on the driver on at most ``max_labelled`` labelled documents (those of least hashed id), from
which the ``max_features`` slots that best tell the grades apart are taken. Prediction is one pass over all documents
in which nothing is shuffled; the broadcast model has a fixed size.

Edge cases: a null or empty text has no features and gets the base rates; labels that are null, that repeat a document
or whose document is missing are ignored or counted as rows; with fewer than two grades in the labels the severity is
that grade's constant; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.kernels import U64, Words, _byte_values, _powers, blocks, column_bytes, forget_tables, mix
from folioforge.llm.storage import mapped, release

PREFIXES = (4, 5, 6, 7, 8, 9)
BITS, MAX_LABELLED, MAX_FEATURES = 20, 6000, 2048


def slots(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every feature occurrence of a block of texts."""
    words = Words(raw, off, "alnum")
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    p, q = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_byte_values()[raw] * p[: len(raw)], out=total[1:])
    docs, found = [doc], [words.hash]
    for k in PREFIXES:
        long = np.flatnonzero(words.end - words.start >= k)
        at = words.start[long]
        docs.append(doc[long])
        found.append(mix((total[at + k] - total[at]) * q[at] + U64(k << 32)))
    return np.concatenate(docs), (np.concatenate(found) >> U64(64 - bits)).view(np.int64)


def counted(doc: np.ndarray, slot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, times = np.unique((doc << bits) | slot, return_counts=True)
    return pair >> bits, pair & ((1 << bits) - 1), times


class OrdinalModel:
    """Weights by slot (0 for slots not selected) and increasing thresholds; ``grades`` are the values in order."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade above the k-th), one column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, max_features: int, steps: int = 400, ridge: float = 2e-3) -> OrdinalModel:
    """``rows``: grade, slots, counts."""
    grades = sorted({g for g, _, _ in rows})
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(1 << bits, np.float32), np.zeros(0))
    y = np.array([grades.index(g) for g, _, _ in rows])
    n = len(y)
    present, seen = np.zeros(1 << bits), np.zeros(1 << bits)
    for g, s, _ in zip(y, (r[1] for r in rows), (r[2] for r in rows), strict=True):
        seen[s] += 1
        present[s] += g > 0
    rate = (y > 0).mean()
    z = np.abs(present - rate * seen) / np.sqrt(rate * (1 - rate) * seen + 1)
    z[seen < 3] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:max_features])
    chosen = chosen[z[chosen] > 0]
    x = np.zeros((n, len(chosen)), np.float32)
    for i, (_, s, c) in enumerate(rows):
        at = np.searchsorted(chosen, s)
        ok = (at < len(chosen)) & (chosen[np.minimum(at, max(len(chosen) - 1, 0))] == s) if len(chosen) else np.zeros(len(s), bool)
        x[i, at[ok]] = np.log1p(c[ok])
    k = len(grades) - 1
    w, theta0, gaps = np.zeros(len(chosen), np.float32), 1.0, np.zeros(k - 1)
    flat = np.concatenate((w, [theta0], gaps))
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, steps + 1):
        w, theta = flat[: len(chosen)], flat[len(chosen)] + np.concatenate(([0.0], np.cumsum(np.exp(flat[len(chosen) + 1 :]))))
        edge = np.concatenate(([-40.0], theta, [40.0]))
        score = x @ w.astype(np.float32)
        upper, lower = 1 / (1 + np.exp(-(edge[y + 1] - score))), 1 / (1 + np.exp(-(edge[y] - score)))
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        ds = (du - dl) / p / n  # of -log p by the score
        dtheta = np.zeros(k + 2)
        np.add.at(dtheta, y + 1, -du / p / n)
        np.add.at(dtheta, y, dl / p / n)
        dtheta = dtheta[1:-1]
        tail = np.cumsum(dtheta[::-1])[::-1]
        grad = np.concatenate((x.T @ ds.astype(np.float32) + ridge * w / 10, [tail[0]], tail[1:] * np.exp(flat[len(chosen) + 1 :])))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        flat = flat - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    table = np.zeros(1 << bits, np.float32)
    table[chosen] = flat[: len(chosen)]
    return OrdinalModel(grades, table, flat[len(chosen)] + np.concatenate(([0.0], np.cumsum(np.exp(flat[len(chosen) + 1 :])))))


def train(docs: DataFrame, labels: DataFrame, grade: Column, doc_id: str, text: str, max_labelled: int, max_features: int, bits: int) -> OrdinalModel:
    picked = labels.select(F.col(doc_id).alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade is not null")
    picked = picked.orderBy(F.xxhash64("id", F.lit(11)), "id", "grade").limit(max_labelled)
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").select("grade", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            raw, off = column_bytes(batch.column(2))
            for a, b in blocks(off):
                doc, slot, times = counted(*slots(raw[off[a] : off[b]], off[a : b + 1] - off[a], bits), bits)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                pack = [np.concatenate((slot[i:j], times[i:j])).astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(pack, pa.binary())], names=["grade", "id", "pack"])

    rows = []
    for r in mapped(chosen, run, f"grade int, id {docs.schema[doc_id].dataType.simpleString()}, pack binary").toLocalIterator():
        both = np.frombuffer(r.pack, np.int32)
        rows.append((r.id, r.grade, both[: len(both) // 2], both[len(both) // 2 :]))
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    model = fit([r[1:] for r in rows], bits, max_features)
    del rows
    forget_tables()
    release()
    return model


def severity(
    docs: DataFrame, labels: DataFrame, grade: Column, doc_id: str = "doc_id", text: str = "text",
    max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, bits: int = BITS, at_least: float = 0.3,
) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (probability of any grade above the least), grade (most likely), toxic.

    ``grade``: an integer column of ``labels``, 0 for harmless.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(train(docs, labels, grade, doc_id, text, max_labelled, max_features, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        model = held.value
        used = model.weights != 0
        levels = np.array(model.grades, np.float64)
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            score = np.zeros(batch.num_rows)
            for a, b in blocks(off):
                doc, slot = slots(raw[off[a] : off[b]], off[a : b + 1] - off[a], bits)
                ok = used[slot]
                doc, slot, times = counted(doc[ok], slot[ok], bits)
                score[a:b] = np.bincount(doc, weights=model.weights[slot] * np.log1p(times), minlength=b - a)
            above = model.exceed(score)
            expected = levels[0] + (above * np.diff(levels)).sum(1)
            any_ = above[:, 0] if above.shape[1] else np.full(len(score), float(levels[0] > 0))
            each = -np.diff(np.concatenate((np.ones((len(score), 1)), above, np.zeros((len(score), 1))), 1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(any_), pa.array(levels[each.argmax(1)].astype(np.int32)), pa.array(any_ >= at_least)], names=[doc_id, "severity", "p_toxic", "grade", "toxic"])

    return mapped(docs.select(doc_id, text), run, f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, severity double, p_toxic double, grade int, toxic boolean")
