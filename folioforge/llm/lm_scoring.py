"""Language-model scores of documents: a word-frequency baseline over the whole corpus and a self-attention model.

1. One pass over all documents gives the subword counts of the training documents, candidates for frequent words (a
   heavy-hitter pass: any word that makes up more than 1 / ``local_top`` of the corpus is among them) and the number of
   words.
2. The network (``attention``) begins with a fit on the driver to a sample of bounded size (``sample_docs`` training
   documents of least hashed id, ``steps`` steps). Then every task goes on from there with each window of each training
   document of its part once, a step of all parameters for each ``tokens_per_step`` words, and the results are averaged by
   what they were learned from: all of the corpus is learned from, and the driver's memory doesn't grow. The same pass
   counts the frequent words exactly.
3. A third pass scores every token once. The frequent words are looked up in the broadcast counts; each other word's
   occurrences, with the network's log-probability of each, go to one partition in packed blocks of arrays, where the
   word is counted and every document's share of the sums is worked out; a second exchange adds the shares by document.
   Memory of a reducer follows the words of its partition, and the number of partitions follows the corpus.

``score``: the sum over tokens of log10(mixture * c / N + (1 - mixture) * P), with c the word's count and N all tokens of
the training documents, and P the network's probability of the word's subwords and of a word being complete after them,
given the text before; so unseen words are spelled out by the network, and words seen anywhere in the corpus are known.

Edge cases: a null or empty text is one end token; rows that repeat an id are told apart by their text, and repeats of
the same row get the same scores; ids may be of any type, and a null id is a value like any other (held out or not as
the caller says); without training documents all counts are 0 and the network scores alone; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.attention import SHARED, Attention, classes, encoder
from folioforge.llm.kernels import U64, Words, blocks, column_bytes, signed
from folioforge.llm.storage import Scratch, mapped, partitions_for

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 500_000  # words whose subwords a task keeps
SLICES = 16  # of the frequent counts, so that their sum over all tasks is no single task's work


def _text_blocks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, Words, np.ndarray]]:
    raw, off = column_bytes(column)
    for a, b in blocks(off, limit):
        yield a, Words(raw[off[a] : off[b]], off[a : b + 1] - off[a], "space"), raw[off[a] : off[b]]


class Subwords:
    """Subword ids of words, each encoded with a space before it. Words are encoded once, as long as they are remembered."""

    def __init__(self, vocabulary: bytes):
        self.encoding, self.ranks = encoder(vocabulary)
        self.size = len(self.ranks) + 1
        self.begins = np.zeros(self.size, bool)  # ids that can only begin a word
        self.begins[[i for piece, i in self.ranks.items() if piece[:1] == b" "]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.begin, self.length = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.array(self.encoding.encode_ordinary(" " + " ".join(words)) if words else [], np.int32)
        first = np.flatnonzero(self.begins[flat])
        if len(first) == len(words):
            return flat, np.diff(np.concatenate((first, [len(flat)])))
        each = [self.encoding.encode_ordinary(" " + x) for x in words]  # white space beyond ASCII can run words together
        return np.array([i for x in each for i in x], np.int32), np.fromiter(map(len, each), np.int64, len(each))

    def pieces(self, w: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``flat`` and length of every distinct word of a block, and which of them each word is."""
        if len(self.known) > REMEMBERED:
            self._forget()
        hashes, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != hashes
        if new.any():
            data = raw.tobytes().lower()
            flat, size = self._encode([data[i:j].decode() for i, j in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(flat)), np.int32)))
            self.flat[self.used : self.used + len(flat)] = flat
            self.known = np.insert(self.known, place[new], hashes[new])
            self.begin = np.insert(self.begin, place[new], self.used + np.cumsum(size) - size)
            self.length = np.insert(self.length, place[new], size)
            self.used += len(flat)
            place = np.searchsorted(self.known, hashes)
        return self.begin[place], self.length[place], at

    def counts(self, w: Words, raw: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """How often each id occurs in the texts of a block that are learned from."""
        begin, size, at = self.pieces(w, raw)
        times = np.bincount(at[np.repeat(learn, w.counts)], minlength=len(size))
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out = np.bincount(self.flat[place], weights=np.repeat(times, size), minlength=self.size).astype(np.int64)
        out[self.size - 1] += int(learn.sum())
        return out

    def stream(self, w: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of a block, each text closed by the end id; their number for each text; where each token (word or end) begins."""
        begin, size, at = self.pieces(w, raw)
        n, doc = size[at], np.repeat(np.arange(len(w.counts)), w.counts)
        before = np.cumsum(n) - n
        total = np.concatenate((before, [int(n.sum())]))
        per_text = total[w.first[1:]] - total[w.first[:-1]] + 1
        out = np.full(int(per_text.sum()), self.size - 1, np.int32)
        inner = np.arange(len(out) - len(w.counts)) - np.repeat(before, n)
        out[np.arange(len(inner)) + np.repeat(doc, n)] = self.flat[np.repeat(begin[at], n) + inner]
        tokens = np.zeros(len(at) + len(w.counts), np.int64)
        tokens[np.arange(len(at)) + doc] = before + doc
        tokens[w.first[1:] + np.arange(len(w.counts))] = np.cumsum(per_text) - 1
        return out, per_text, tokens


def _survey(rows: DataFrame, vocabulary, local_top: int) -> DataFrame:
    """kind, h, n: 0 counts of locally frequent words, 1 subword counts of training documents, 2 the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        words, counts, total = np.zeros(0, U64), np.zeros(0, np.int64), 0
        sub = Subwords(vocabulary.value)
        pieces = np.zeros(sub.size, np.int64)
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, w, raw in _text_blocks(batch.column(0)):
                total += len(w.hash)
                pieces += sub.counts(w, raw, learn[a : a + len(w.counts)])
                h, n = np.unique(w.hash, return_counts=True)
                words, inverse = np.unique(np.concatenate((words, h)), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate((counts, n)), minlength=len(words)).astype(np.int64)
                if len(words) > 16 * local_top:
                    top = np.sort(np.argsort(-counts, kind="stable")[: 4 * local_top])
                    words, counts = words[top], counts[top]
        top, seen = np.argsort(-counts, kind="stable")[:local_top], np.flatnonzero(pieces)
        for kind, h, n in ((0, signed(words[top]), counts[top]), (1, seen, pieces[seen]), (2, np.zeros(1, np.int64), np.array([total]))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(n)], names=["kind", "h", "n"])

    return mapped(rows.select("text", "learn"), run, "kind int, h bigint, n bigint").groupBy("kind", "h").agg(F.sum("n").alias("n"))


def _fit(rows: DataFrame, sample_docs: int, vocabulary: bytes, counts: np.ndarray, steps: int) -> tuple[Attention, np.ndarray, np.ndarray]:
    """The network fitted on the sample, log10 P(id | class), and which classes complete a word."""
    learned = rows.where("learn")
    n = learned.count()
    least = int((1 << 40) * min(1.0, (sample_docs + 4 * sample_docs**0.5 + 10) / n)) if n else 0
    chosen = learned.select("text", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 40)).alias("h")).where(F.col("h") <= least)
    got = sorted((r.h, r.text) for r in chosen.toLocalIterator())[:sample_docs]
    sub = Subwords(vocabulary)
    of, inner, stops = classes(counts, sub.ranks)
    streams, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, w, raw in _text_blocks(pa.array([t for _, t in got], pa.string())):
        s, k, _ = sub.stream(w, raw)
        streams.append(s)
        sizes.append(k)
    return Attention(of).fit(np.concatenate(streams), np.concatenate(sizes), steps), inner, stops


def _refined(rows: DataFrame, model, common, vocabulary, tokens_per_step: int, parts: int) -> DataFrame:
    """name, data: counts of the frequent words (in slices), of training texts and words, the sums of the shared parameters weighted by the words learned from,
    and for slices of the ids the sums of their own parts' changes with the number of steps that made them. Every window of every training text is learned from once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        frequent, sub, net, state = common.value, Subwords(vocabulary.value), Attention(model.value[0].of), {}
        net.p = {k: v.copy() for k, v in model.value[0].p.items()}
        dense = np.zeros(len(frequent) + 2, np.int64)
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            train = batch.column(0).filter(pa.array(learn))
            for _, w, raw in _text_blocks(train):
                if len(frequent):
                    at = np.searchsorted(frequent, w.hash)
                    hit = frequent[np.minimum(at, len(frequent) - 1)] == w.hash
                    dense[:-2] += np.bincount(at[hit], minlength=len(frequent))
                words = len(w.hash) + len(w.counts)
                dense[-2:] += (len(w.counts), words)
                ids, sizes, _ = sub.stream(w, raw)
                net.learn(ids, sizes, words, state, tokens_per_step)
        net.learn_rest(state, tokens_per_step)
        done = state.get("words", 0.0)
        out = [(f"count:{k}", x.tobytes()) for k, x in enumerate(np.array_split(dense, SLICES))]
        out.append(("words", np.array([done]).tobytes()))
        if done:
            out += [(n, (net.p[n].astype(np.float64) * done).tobytes()) for n in SHARED]
            times = state["times"][:, None]
            own = np.concatenate(((net.p["own"] - model.value[0].p["own"]) * times, times), 1).astype(np.float32)
            out += [(f"own:{k}", x.tobytes()) for k, x in enumerate(np.array_split(own, SLICES))]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out]), pa.array([x for _, x in out], pa.binary())], names=["name", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held = {"count": np.int64, "own": np.float32}, {}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_buffer(), kinds.get(name.split(":")[0], np.float64))
                x = x.astype(np.float64) if name.startswith("own:") else x
                held[name] = held[name] + x if name in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["name", "data"])

    sums = mapped(rows.select("text", "learn"), run, "name string, data binary")
    return mapped(sums.repartition(parts, "name"), add, "name string, data binary")


SCORED = "part int, block binary, id {id}, learned boolean, row_key bigint, n_tokens bigint, known bigint, base double, score double"


def _token_values(net: Attention, inner: np.ndarray, stops: np.ndarray, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """log10 P(token | text before) of words and ends: the subwords, given that a token begins, and that the token ends there. ``opens``: first token of each text."""
    each, stop = net.score(ids, sizes, stops)
    value = np.add.reduceat((each + inner[ids]).astype(np.float64), tokens) if len(tokens) else np.zeros(0)
    begun = stop[tokens].astype(np.float64)
    begun[opens] = 0
    value -= begun
    value[:-1] += begun[1:]  # 0 where the next token opens a text
    return np.minimum(value, 0.0)


def _mixed(count: np.ndarray, total: int, value: np.ndarray, mixture: float) -> np.ndarray:
    """log10 of the mixture of a word's frequency and the network's probability."""
    if not total:
        return value
    spelled = (1 - mixture) * 10.0 ** np.maximum(value, -300.0)
    return np.log10(mixture * count / total + spelled)


def _scatter(rows: DataFrame, held, common, vocabulary, partitions: int, mixture: float) -> DataFrame:
    """A row per document with the sums over frequent words, and packed blocks of the rare ones: per partition hashes, document numbers, counts and the network's values, with the block's row keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        net, inner, stops, dense = held.value
        frequent, sub = common.value, Subwords(vocabulary.value)
        log, total = np.log10(dense[:-2] + 0.5), int(dense[-1])
        end, end_known = float(np.log10(dense[-2] + 0.5)), int(dense[-2] > 0)
        for batch in batches:
            row_keys = batch.column(1).to_numpy()
            train_all = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for a, w, raw in _text_blocks(batch.column(2)):
                n = len(w.counts)
                keys, train = row_keys[a : a + n], train_all[a : a + n]
                doc = np.repeat(np.arange(n), w.counts)
                ids, sizes, tokens = sub.stream(w, raw)
                opens = w.first[:-1] + np.arange(n)
                value = _token_values(net, inner, stops, ids, sizes, tokens, opens)
                ends, value = value[w.first[1:] + np.arange(n)], value[np.arange(len(doc)) + doc]
                at = np.searchsorted(frequent, w.hash)
                hit = frequent[np.minimum(at, len(frequent) - 1)] == w.hash if len(frequent) else np.zeros(len(at), bool)
                count = dense[at[hit]]
                base = np.bincount(doc[hit], weights=log[at[hit]], minlength=n) + end
                score = np.bincount(doc[hit], weights=_mixed(count, total, value[hit], mixture), minlength=n) + _mixed(dense[-2], total, ends, mixture)
                known = np.bincount(doc[hit], weights=count > 0, minlength=n).astype(np.int64) + end_known
                part = (keys.view(U64) >> U64(32)) % U64(partitions)
                columns = [pa.array(part.astype(np.int32)), pa.nulls(n, pa.binary()), batch.column(0).slice(a, n), batch.column(3).slice(a, n), pa.array(keys), pa.array(w.counts + 1), pa.array(known), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                packed = _packed(w.hash[~hit], doc[~hit], value[~hit], keys, train, partitions)
                m = len(packed)
                empty = [pa.nulls(m, c.type) for c in columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary()), *empty], names=names)

    schema = SCORED.format(id=rows.schema["id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    return mapped(rows.select("id", "row_key", "text", "learn"), run, schema)


def _packed(h: np.ndarray, d: np.ndarray, value: np.ndarray, keys: np.ndarray, train: np.ndarray, partitions: int) -> list[tuple[int, bytes]]:
    part = ((h >> U64(32)) % U64(partitions)).view(np.int64)
    order = np.lexsort((d, h, part))
    h, d, value, part = h[order], d[order], value[order].astype(np.float32), part[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate((first, [len(h)])))
    cuts = np.searchsorted(part, np.arange(partitions + 1))
    pairs = np.searchsorted(first, cuts)
    h, d, out = h[first], d[first], []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        pick = slice(pairs[p], pairs[p + 1])
        rows, local = np.unique(d[pick], return_inverse=True)
        wide = np.uint16 if len(rows) < 65536 else np.uint32
        big = tf[pick] > 254
        head = np.array([len(local), len(rows), wide().itemsize, int(big.sum()), cuts[p + 1] - cuts[p]], np.int64)
        parts = (head, h[pick], keys[rows], train[rows], local.astype(wide), np.minimum(tf[pick], 255).astype(np.uint8), np.flatnonzero(big), tf[pick][big], value[cuts[p] : cuts[p + 1]])
        out.append((p, b"".join(x.tobytes() for x in parts)))
    return out


def _unpack(block: bytes) -> tuple[np.ndarray, ...]:
    n, rows, wide, big, words = np.frombuffer(block, np.int64, 5).tolist()
    at, out = 40, []
    for kind, size in ((U64, n), (np.int64, rows), (np.bool_, rows), (np.uint16 if wide == 2 else np.uint32, n), (np.uint8, n), (np.int64, big), (np.int64, big), (np.float32, words)):
        out.append(np.frombuffer(block, kind, size, at))
        at += size * np.dtype(kind).itemsize
    h, keys, train, local, tf, where, value, values = out
    tf = tf.astype(np.int64)
    tf[where] = value
    return h, keys[local], train[local], tf, values


def _gather(blocks_: DataFrame, partitions: int, total: int, mixture: float) -> DataFrame:
    """Documents' rows as they are; shares of documents in the sums over rare words, packed again by row key; part -2: distinct rare training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: dict[int, list] = {}
        kinds, names = None, None
        for batch in batches:
            names, kinds = batch.schema.names, [c.type for c in batch.columns]
            documents = batch.column(1).is_null()
            if documents.true_count:
                yield batch.filter(documents)
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block.is_valid:
                    held.setdefault(p, []).append(_unpack(block.as_py()))
        if not held:
            return

        def packed(parts: list[int], data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary()), *(pa.nulls(len(parts), k) for k in kinds[2:])], names=names)

        distinct = 0
        for p in list(held):
            h, keys, train, tf, value = (np.concatenate(x) for x in zip(*held.pop(p), strict=True))
            words, at = np.unique(h, return_inverse=True)
            c = np.bincount(at, weights=tf * train, minlength=len(words))
            distinct += int((c > 0).sum())
            rows, own = np.unique(keys, return_inverse=True)
            share = np.bincount(own, weights=tf * np.log10(c[at] + 0.5), minlength=len(rows))
            known = np.bincount(own, weights=tf * (c[at] > 0), minlength=len(rows)).astype(np.uint32)
            score = np.bincount(np.repeat(own, tf), weights=_mixed(np.repeat(c[at], tf), total, value.astype(np.float64), mixture), minlength=len(rows))
            to = ((rows.view(U64) >> U64(32)) % U64(partitions)).view(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(partitions + 1))
            out = [(q, b"".join(x[i].tobytes() for x in (rows, share, score, known))) for q in range(partitions) if len(i := order[cuts[q] : cuts[q + 1]])]
            yield packed([q for q, _ in out], [x for _, x in out])
        yield packed([-2], [np.array([distinct]).tobytes()])

    return mapped(blocks_.repartition(partitions, "part"), run, blocks_.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


def _shares(packed: DataFrame, partitions: int) -> DataFrame:
    """row_key, share, rare, known: sums over rare words by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for block in batch.column(1):
                block = block.as_py()
                n = len(block) // 28
                held.append((np.frombuffer(block, np.int64, n), *(np.frombuffer(block, np.float64, n, k * n) for k in (8, 16)), np.frombuffer(block, np.uint32, n, 24 * n)))
        if held:
            keys, share, score, known = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((score, share, keys))  # sums do not depend on the order of arrival
            rows, first = np.unique(keys[order], return_index=True)
            sums = [np.add.reduceat(x[order], first) for x in (share, score, known.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(rows), *map(pa.array, sums)], names=["row_key", "share", "rare", "known_rare"])

    return mapped(packed.select("part", "block").repartition(partitions, "part"), run, "row_key bigint, share double, rare double, known_rare bigint")


def score(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    sample_docs: int = 1500, steps: int = 1500, tokens_per_step: int = 40_000, mixture: float = 0.85,
    local_top: int = 8192, frequent_words: int = 16_384, tokens_per_partition: int = 4_000_000,
) -> DataFrame:
    """doc_id, learned (whether the row was learned from), n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    ``vocabulary``: a file on the driver. ``mixture``: weight of a word's frequency against its spelling.
    """
    spark = docs.sparkSession
    context, scratch = spark.sparkContext, Scratch(spark, "lm")
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), learn.alias("learn")).withColumn("row_key", F.xxhash64("id", "text"))
    with open(vocabulary, "rb") as f:
        file = f.read()
    shipped = context.broadcast(file)
    found = scratch.save(_survey(rows, shipped, local_top), "survey")
    words = int(found.where("kind = 2").agg(F.sum("n")).first()[0] or 0)
    common = np.sort(np.array([r.h for r in found.where("kind = 0").orderBy(F.desc("n"), "h").limit(frequent_words).collect()], np.int64).view(U64))
    pieces = np.zeros(len(encoder(file)[1]) + 1)  # one number for each id of the vocabulary
    for r in found.where("kind = 1").collect():
        pieces[r.h] = r.n
    parts = max(partitions_for(spark), -(-words // tokens_per_partition))
    frequent = context.broadcast(common)
    net, inner, stops = _fit(rows, sample_docs, file, pieces, steps)
    sums = {r.name: r.data for r in _refined(rows, context.broadcast((net,)), frequent, shipped, tokens_per_step, min(parts, 2 * SLICES + len(SHARED))).collect()}
    dense = np.concatenate([np.frombuffer(sums[f"count:{k}"], np.int64) for k in range(SLICES)]) if sums else np.zeros(len(common) + 2, np.int64)
    done = float(np.frombuffer(sums["words"], np.float64)[0]) if sums else 0.0
    if done:
        for n in SHARED:
            net.p[n] = (np.frombuffer(sums[n], np.float64).reshape(net.p[n].shape) / done).astype(np.float32)
        own = np.concatenate([np.frombuffer(sums[f"own:{k}"], np.float64) for k in range(SLICES)]).reshape(len(net.p["own"]), -1)
        net.p["own"] += (own[:, :-1] / np.maximum(own[:, -1:], 1)).astype(np.float32)
    net.table = None
    total = int(dense[-1])
    held = context.broadcast((net, inner.astype(np.float32), stops, dense))
    scored = scratch.save(_gather(_scatter(rows, held, frequent, shipped, parts, mixture), parts, total, mixture), "scored", "lz4")
    distinct = sum(int(np.frombuffer(r.block, np.int64)[0]) for r in scored.where("part = -2").toLocalIterator()) + int((dense[:-1] > 0).sum())
    unit = float(np.log10(total + 0.5 * (distinct + 1)))
    documents = scored.where("block is null")
    times = documents.groupBy("row_key").agg(F.count("*").alias("times"))  # rows that repeat share one sum
    shares = _shares(scored.where("part >= 0 and block is not null"), parts).join(times, "row_key")
    shares = shares.select("row_key", *[(F.col(c) / F.col("times")).alias(c) for c in ("share", "rare", "known_rare")])
    out = documents.join(shares, "row_key", "left")

    def rest(c: str) -> Column:
        return F.coalesce(c, F.lit(0.0))

    base = F.col("base") + rest("share") - F.col("n_tokens") * F.lit(unit)
    return out.select(
        F.col("id").alias(doc_id), "learned", "n_tokens", (F.col("known") + rest("known_rare")).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("score") + rest("rare")).alias("score"),
    )
