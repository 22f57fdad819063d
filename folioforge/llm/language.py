"""Language identification with a linear-chain conditional random field over words.

Each word is labelled with a language by forward-backward over its whole line, so code-switched text gets a label per
word (``words=True`` returns them); long lines are worked off in segments whose transfer matrices make the result the
same as without them. Features of a word: its lexicon entry (words seen
``LEXICON_MIN`` times or more in the training sample), its affixes (first and last 1 to 4 bytes) and its byte
trigrams, hashed to ``2**BITS`` slots with one weight per language; transitions and start weights are learned with
them. Training chains are pieces of lines of the sample (``MAX_CHAIN`` words at most), and pieces of two languages
spliced at a random word.

A document's language is the one with the most expected words among its words with letters; the score is that share.

The fit uses at most ``per_language`` documents of each language (those of least hashed id) and ``max_chains`` chains
of them; all of it happens on the driver in bounded memory. Prediction is one pass without a shuffle.

Edge cases: a null text and a text without any letter is ``und`` with score 0; with no labelled document everything
is ``und``; repeated rows get a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.kernels import U64, Words, _byte_values, _powers, blocks, column_bytes, forget_tables, mix
from folioforge.llm.storage import mapped, release

BITS, MAX_CHAIN, LEXICON_MIN, MAX_LANGUAGES = 17, 64, 5, 256
AFFIXES = (1, 2, 3, 4)
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


class Tokens:
    """Words of a block of texts with their feature slots and their chains."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        w = Words(raw, off, "space")
        self.counts, self.doc = w.counts, np.repeat(np.arange(len(w.counts)), w.counts)
        n, low = len(raw), U64((1 << BITS) - 1)
        p, q = _powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_byte_values()[raw] * p[:n], out=total[1:])
        size = w.end - w.start
        self.lexicon = (mix(w.hash + U64(1)) & low).astype(np.int32)
        self.affix = []
        for k in AFFIXES:
            use = np.minimum(size, k)
            for salt, at in ((2 * k, w.start), (2 * k + 1, w.end - use)):
                self.affix.append((mix((total[at + use] - total[at]) * q[at] + U64(salt << 40)) & low).astype(np.int32))
        grams = np.maximum(size - 2, 0)
        self.gram_first = np.concatenate(([0], np.cumsum(grams)))
        at = np.arange(int(grams.sum())) + np.repeat(w.start - self.gram_first[:-1], grams)
        b = raw.astype(np.int64)
        b[65 <= b] += 32 * ((b[65 <= b] <= 90))
        self.gram = (mix((b[at] | (b[at + 1] << 8) | (b[at + 2] << 16)).astype(U64) + U64(99 << 40)) & low).astype(np.int32)
        letters = np.concatenate(([0], np.cumsum(LETTERS[raw])))
        self.letter = letters[w.end] > letters[w.start]
        breaks = np.concatenate(([0], np.cumsum(raw == 10)))[w.start] if n else w.start
        new = np.ones(len(w.hash), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.concatenate((self.first, [len(new)])))


def emissions(t: Tokens, weights: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Score of every word (row) for every language. Weights: slots x languages."""
    out = np.where(known[t.lexicon][:, None], weights[t.lexicon], 0.0).astype(np.float32)
    for a in t.affix:
        out += weights[a]
    run = np.zeros((len(t.gram) + 1, weights.shape[1]), np.float64)
    np.cumsum(weights[t.gram], axis=0, out=run[1:])
    out += run[t.gram_first[1:]] - run[t.gram_first[:-1]]
    return out


def forward_backward(scores: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posterior of every word; with ``pairs`` also the summed posterior of neighbouring labels and of first labels, and the log-partition."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) if len(length) else 0)]
    top = scores.max(1, keepdims=True)
    e = np.exp(scores - top)
    a = np.exp(trans)
    alpha, norm = np.empty_like(e), np.empty(len(e), e.dtype)
    for t, n in enumerate(active):
        at = first[:n] + t
        x = (np.exp(start)[None, :] if t == 0 else alpha[at - 1] @ a) * e[at]
        s = x.sum(1)
        alpha[at], norm[at] = x / s[:, None], s
    beta = np.ones_like(e)
    both, begin = np.zeros_like(a), np.zeros(len(start))
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        follow = e[at] * beta[at] / norm[at][:, None]
        beta[at - 1] = follow @ a.T
        if pairs:
            both += (alpha[at - 1].T @ follow) * a
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post
    begin = post[first].sum(0)
    return post, both, begin, float(np.log(norm).sum() + top.sum())


def posteriors(scores: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, trans: np.ndarray, segment: int = 128) -> np.ndarray:
    """As ``forward_backward``; chains longer than ``segment`` take a step per word of a segment, not per word of the chain."""
    pieces = -(-length // segment)
    if not len(length) or pieces.max() <= 1:
        return forward_backward(scores, first, length, start, trans)
    chain = np.repeat(np.arange(len(length)), pieces)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[chain] + number * segment
    size = np.minimum(segment, length[chain] - number * segment)
    order = np.argsort(-size, kind="stable")  # segments from here on by size
    number, begin, size = number[order], begin[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = place[np.maximum(order - 1, 0)]  # the segment before, where there is one
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    a, labels = np.exp(trans).astype(np.float64), scores.shape[1]

    move = np.broadcast_to(np.eye(labels), (len(size), labels, labels)).copy()
    for t, n in enumerate(active):
        move[:n] = (move[:n] @ a) * e[begin[:n] + t][:, None, :]
        move[:n] /= move[:n].max((1, 2), keepdims=True)
    levels = [np.flatnonzero(number == k) for k in range(int(number.max()) + 1)]
    entry, ends = np.zeros((len(size), labels)), np.zeros((len(size), labels))
    alpha = np.zeros_like(e)

    def forward(of: np.ndarray) -> None:
        for t, n in enumerate(active):
            s = of[of < n]
            at = begin[s] + t
            x = np.where((number[s] == 0)[:, None], np.exp(start)[None, :], entry[s] @ a) if t == 0 else alpha[at - 1] @ a
            x = x * e[at]
            alpha[at] = x / x.sum(1, keepdims=True)

    forward(levels[0])
    ends[levels[0]] = alpha[begin[levels[0]] + size[levels[0]] - 1]
    for of in levels[1:]:
        entry[of] = ends[before[of]]
        x = np.einsum("ij,ijk->ik", entry[of], move[of])
        ends[of] = x / x.sum(1, keepdims=True)
    forward(np.flatnonzero(number > 0))
    tails = np.ones((len(size), labels))
    for of in levels[:0:-1]:
        x = np.einsum("ijk,ik->ij", move[of], tails[of])
        tails[before[of]] = x / x.sum(1, keepdims=True)
    beta = np.ones_like(e)
    beta[begin + size - 1] = tails
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        x = (e[at] * beta[at]) @ a.T
        beta[at - 1] = x / x.sum(1, keepdims=True)
    post = alpha * beta
    return post / post.sum(1, keepdims=True)


class Chain:
    """Feature slots of a piece of a line, apart from the block that it came from, and its language."""

    __slots__ = ("affix", "gram", "gram_first", "lang", "lexicon")

    def __init__(self, t: Tokens, i: int, j: int, lang: int):
        self.lexicon, self.lang = t.lexicon[i:j].copy(), lang
        self.affix = np.stack([x[i:j] for x in t.affix])
        self.gram = t.gram[t.gram_first[i] : t.gram_first[j]].copy()
        self.gram_first = (t.gram_first[i : j + 1] - t.gram_first[i]).astype(np.int32)

    def __len__(self) -> int:
        return len(self.lexicon)


def _sampled(texts: list[str], langs: list[int], max_chains: int, rng: np.random.Generator) -> tuple[list[Chain], np.ndarray]:
    """At most ``max_chains`` chains of all texts at random, and how often each lexicon slot occurs in the texts."""
    raw, off = column_bytes(pa.array(texts, pa.string()))
    seen, held = np.zeros(1 << BITS, np.int64), []
    for a, b in blocks(off, 1 << 20):
        t = Tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        seen += np.bincount(t.lexicon, minlength=1 << BITS)
        pieces = -(-t.length // MAX_CHAIN)
        line = np.repeat(np.arange(len(pieces)), pieces)
        first = t.first[line] + (np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MAX_CHAIN
        last = np.minimum(first + MAX_CHAIN, (t.first + t.length)[line])
        least = held[max_chains - 1][0] if len(held) >= max_chains else 1.0
        for k, i, j in zip(rng.random(len(line)).tolist(), first.tolist(), last.tolist(), strict=True):
            if k < least:
                held.append((k, Chain(t, i, j, langs[t.doc[i] + a])))
        held = sorted(held, key=lambda x: x[0])[:max_chains]
    return [c for _, c in held], seen


def fit(texts: list[str], langs: list[int], n_langs: int, max_chains: int, epochs: int = 4, batch: int = 256, seed: int = 5) -> dict:
    """Weights, transitions, start weights and the lexicon, by Adagrad on the likelihood of the chains."""
    rng = np.random.default_rng(seed)
    chains, seen = _sampled(texts, langs, max_chains, rng)
    known = seen >= LEXICON_MIN
    weights, trans, start = np.zeros((1 << BITS, n_langs), np.float32), np.zeros((n_langs, n_langs)), np.zeros(n_langs)
    sums = [np.full(x.shape, 1e-3, np.float64 if x.ndim < 2 or len(x) == n_langs else np.float32) for x in (weights, trans, start)]

    def gather(sequence: list[list[tuple]]) -> tuple:
        slots, word, gold, size, at = [], [], [], [], 0
        for pieces in sequence:
            begun = at
            for c, i, j in pieces:
                n = j - i
                ids = np.arange(at, at + n)
                lex = c.lexicon[i:j]
                slots += [lex[known[lex]], *c.affix[:, i:j], c.gram[c.gram_first[i] : c.gram_first[j]]]
                word += [ids[known[lex]], *([ids] * len(c.affix)), np.repeat(ids, np.diff(c.gram_first[i : j + 1]))]
                gold.append(np.full(n, c.lang))
                at += n
            size.append(at - begun)
        return np.concatenate(slots), np.concatenate(word), np.concatenate(gold), np.array(size)

    for epoch in range(epochs):
        for lo in range(0, len(chains), batch):
            group = [chains[i] for i in rng.integers(0, len(chains), min(batch, len(chains)))] if epoch else chains[lo : lo + batch]
            sequence = []
            for c in group:
                other = chains[rng.integers(len(chains))]
                cut = [int(rng.integers(0, len(x) + 1)) for x in (c, other)]
                spliced = [x for x in ((c, 0, cut[0]), (other, cut[1], len(other))) if x[2] > x[1]]
                sequence.append(spliced if rng.random() < 0.3 and spliced else [(c, 0, len(c))])
            slots, word, gold, size = gather(sequence)
            score = np.stack([np.bincount(word, weights=weights[slots, k], minlength=len(gold)) for k in range(n_langs)], 1)
            first = np.cumsum(size) - size
            post, both, begin, _ = forward_backward(score, first, size, start, trans, True)
            wrong = post.copy()
            wrong[np.arange(len(gold)), gold] -= 1
            wrong /= len(size)
            follow = np.ones(len(gold), bool)
            follow[first] = False
            at = np.flatnonzero(follow)
            np.subtract.at(both, (gold[at - 1], gold[at]), 1)
            np.subtract.at(begin, gold[first], 1)
            grads = (np.stack([np.bincount(slots, weights=wrong[word, k], minlength=1 << BITS) for k in range(n_langs)], 1).astype(np.float32), both / len(size), begin / len(size))
            for x, s, g in zip((weights, trans, start), sums, grads, strict=True):
                s += g * g
                x -= 0.1 * g / np.sqrt(s)
    return {"weights": weights, "trans": trans, "start": start, "known": known}


def train(docs: DataFrame, learn: Column, doc_id: str, text: str, lang: str, per_language: int, max_chains: int) -> tuple[list[str], dict]:
    rows = docs.where(learn).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(doc_id), F.lit(3)), F.lit(1 << 30)).alias("h")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = [r.lang for r in sizes]
    if not names:
        return names, {}
    # a share of hashes with room to spare around the wanted number; the least hashes of each language are then kept
    least = F.lit(0)
    for r in sizes:
        share = min(1.0, (per_language + 4 * per_language**0.5 + 10) / r["count"])
        least = F.when(F.col("lang") == r.lang, int(share * (1 << 30))).otherwise(least)
    got = sorted((r.lang, r.h, r.text) for r in rows.where(F.col("h") <= least).toLocalIterator())
    kept, counts = [], dict.fromkeys(names, 0)
    for name, _, body in got:
        counts[name] += 1
        if counts[name] <= per_language:
            kept.append((body, names.index(name)))
    model = fit([t for t, _ in kept], [k for _, k in kept], len(names), max_chains)
    forget_tables()
    release()
    return names, model


def identify(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: DataFrame | None = None,
    per_language: int = 400, max_chains: int = 12_000, passes: tuple[str, ...] = (), words: bool = False, pred_name: str = "lang_pred", score_name: str = "score",
) -> DataFrame:
    """doc_id, the columns named in ``passes``, lang_pred, score and, with ``words``, word_langs: the likeliest language of every word.

    ``learn``: which rows of ``train_docs`` (default: ``docs``) may be learned from. ``per_language``, ``max_chains``:
    bounds of the sample that the model is fitted on.
    """
    spark = docs.sparkSession
    names, model = train(docs if train_docs is None else train_docs, learn, doc_id, text, lang, per_language, max_chains)
    held = spark.sparkContext.broadcast((names, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        names, m = held.value
        for batch in batches:
            raw, off = column_bytes(batch.column(0))
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            labels, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in blocks(off, 1 << 20):
                t = Tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                counts.append(t.counts)
                if not len(t.doc) or not names:
                    labels.append(np.full(len(t.doc), len(names)))
                    continue
                post = posteriors(emissions(t, m["weights"], m["known"]), t.first, t.length, m["start"].astype(np.float32), m["trans"].astype(np.float32))
                labels.append(post.argmax(1) if words else labels[0])
                mass = np.stack([np.bincount(t.doc[t.letter], weights=post[t.letter, k], minlength=b - a) for k in range(len(names))], 1)
                total = mass.sum(1)
                plain = np.concatenate(([0], np.cumsum((LETTERS & (np.arange(256) < 128))[raw[off[a] : off[b]]])))
                has = plain[off[a + 1 : b + 1] - off[a]] > plain[off[a:b] - off[a]]
                for d in np.flatnonzero(total > 0).tolist():
                    if has[d] or any(c.isalpha() for c in raw[off[a + d] : off[a + d + 1]].tobytes().decode()):
                        best = int(mass[d].argmax())
                        pred[a + d], score[a + d] = names[best], min(1.0, mass[d, best] / total[d])
            more = []
            if words:
                ends = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
                more = [pa.ListArray.from_arrays(ends, pa.array([*names, "und"]).take(pa.array(np.concatenate(labels))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score), *more], names=[*batch.schema.names[1:], pred_name, score_name, *["word_langs"][: len(more)]])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (doc_id, *passes))
    return mapped(docs.select(text, doc_id, *passes), run, f"{kinds}, `{pred_name}` string, `{score_name}` double{', word_langs array<string>' if words else ''}")
