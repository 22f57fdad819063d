"""A small causal self-attention language model on subword ids, in numpy: fit, refine, and score in overlapping windows.

Inputs are subword ids of a public byte-level BPE vocabulary: an id's vector is that of its class and a learned part of
its own. The network (one masked attention head, one hidden layer, learned positions) predicts the next id as its class
and, within the class, its smoothed frequency in the corpus. Classes: the end of a text, the most frequent ids one by
one, and the others by whether they begin a word and by their first byte. Both parts are normalised, so the score of a
text is a log-probability of its subwords and its end; and as no class mixes ids that begin a word with others, the
mass of the former is the probability that the word before is complete.
"""

from __future__ import annotations

import base64

import numpy as np

WINDOW, OVERLAP, WIDTH, HIDDEN = 16, 4, 16, 32
SINGLE, TAIL = 127, 32
CLASSES = 1 + SINGLE + TAIL
SAFE = 60.0  # exponents up to this need no shift in single precision
SHARED = ("emb", "pos", "q", "k", "v", "o", "w1", "b1", "w2", "out", "bias")  # all but the ids' own parts


def encoder(data: bytes):
    """The tokenizer of a vocabulary file's bytes (ranks, one per line). Never trained here."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def classes(counts: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every id (the last id is the end of a text), log10 P(id | class), from training counts, and which classes complete a word."""
    size = len(counts)
    of, stops = np.zeros(size, np.int16), np.zeros(CLASSES, bool)
    stops[0] = True
    stops[1 + SINGLE + 16 :] = True
    begins = np.zeros(size, bool)
    for piece, i in ranks.items():
        begins[i] = piece[:1] == b" "
        first = (piece[1:2] if begins[i] else piece[:1]) or b" "
        of[i] = 1 + SINGLE + 16 * begins[i] + first[0] % 16
    top = np.argsort(-counts[:-1], kind="stable")[:SINGLE]
    of[top] = 1 + np.arange(len(top))
    stops[1 + np.arange(len(top))] = begins[top]
    of[size - 1] = 0
    mass = np.bincount(of, weights=counts + 0.5, minlength=CLASSES)
    return of, np.log10((counts + 0.5) / mass[of]), stops


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of ``sizes`` targets each: text, first target, and the first target that the window scores."""
    stride = WINDOW - OVERLAP
    n = np.maximum(1, -(-(sizes - OVERLAP) // stride))
    n[sizes == 0] = 0
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return text, k * stride, np.where(k > 0, k * stride + OVERLAP, 0)


class Attention:
    """``of``: class of every id, the last id being the end of a text."""

    def __init__(self, of: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, h, c = WIDTH, HIDDEN, CLASSES
        shapes = {"emb": (c, d), "pos": (WINDOW, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "w1": (d, h), "b1": (h,), "w2": (h, d), "out": (d, c), "bias": (c,)}
        self.p = {n: (rng.normal(0, 0.5 / np.sqrt(s[0]) if len(s) > 1 and n not in ("emb", "pos") else 0.3, s) * (n not in ("b1", "bias"))).astype(np.float32) for n, s in shapes.items()}
        self.of, self.p["own"] = of, np.zeros((len(of), d), np.float32)
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.table = None

    def vectors(self, ids: np.ndarray, keep: bool) -> np.ndarray:
        if keep:  # while learning the table changes with every step
            return self.p["emb"][self.of[ids]] + self.p["own"][ids]
        if self.table is None:
            self.table = self.p["emb"][self.of] + self.p["own"]
        return self.table[ids]

    def hidden(self, ids: np.ndarray, keep: bool = False):
        """States after each input of ``ids`` (windows x positions)."""
        p = self.p
        x = self.vectors(ids, keep) + p["pos"][None, : ids.shape[1]]
        shape, flat = x.shape, x.reshape(-1, WIDTH)  # one product for all windows
        q, k, v = ((flat @ p[n]).reshape(shape) for n in "qkv")
        q *= np.float32(WIDTH**-0.5)
        a = q @ k.transpose(0, 2, 1)
        a += self.mask[: ids.shape[1], : ids.shape[1]]
        if keep or a.max() > SAFE:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        c = a @ v
        y = flat + c.reshape(-1, WIDTH) @ p["o"]
        u = y @ p["w1"]
        u += p["b1"]
        np.maximum(u, 0, out=u)
        z = (y + u @ p["w2"]).reshape(shape)
        return (x, q, k, v, a, c, y.reshape(shape), u.reshape(*shape[:2], -1), z) if keep else z

    def loss(self, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean cross-entropy of the target classes, gradients of the shared parameters, and of every input's vector."""
        p = self.p
        x, q, k, v, a, c, y, u, z = self.hidden(ids, True)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        total, at, hit = weight.sum(), np.arange(ids.size), target.reshape(-1)
        w = weight.reshape(-1) / total
        g = flat(z) @ p["out"]
        g += p["bias"]
        if np.abs(g).max() > SAFE:
            g -= g.max(-1, keepdims=True)
        np.exp(g, out=g)
        mass = g.sum(-1)
        value = -(np.log(np.maximum(g[at, hit] / mass, 1e-12)) * w).sum()
        g *= (w / mass)[:, None]
        g[at, hit] -= w
        grad = {"out": flat(z).T @ g, "bias": g.sum(0)}
        dz = (g @ p["out"].T).reshape(z.shape)
        du = (dz @ p["w2"].T) * (u > 0)
        grad |= {"w2": flat(u).T @ flat(dz), "w1": flat(y).T @ flat(du), "b1": flat(du).sum(0)}
        dy = dz + du @ p["w1"].T
        grad["o"] = flat(c).T @ flat(dy)
        dc = dy @ p["o"].T
        da = dc @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ dc
        ds = a * (da - (da * a).sum(-1, keepdims=True)) * np.float32(WIDTH**-0.5)
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q / np.float32(WIDTH**-0.5)  # q is kept scaled
        grad |= {"q": flat(x).T @ flat(dq), "k": flat(x).T @ flat(dk), "v": flat(x).T @ flat(dv)}
        dx = dy + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
        grad["pos"] = dx.sum(0)
        of = self.of[ids.reshape(-1)]
        grad["emb"] = np.stack([np.bincount(of, m, CLASSES) for m in flat(dx).T], 1).astype(dx.dtype)
        return float(value), grad, flat(dx)

    def fit(self, stream: np.ndarray, sizes: np.ndarray, steps: int = 1500, batch: int = 160, rate: float = 0.01, seed: int = 2) -> Attention:
        """``stream``: ids of the training texts, each closed by the end id, of ``sizes``. Learns all parameters."""
        rng = np.random.default_rng(seed)
        text, first, _ = windows(sizes)
        begin = (np.cumsum(sizes) - sizes)[text]
        moments = {n: (np.zeros_like(x), np.zeros_like(x)) for n, x in self.p.items()}
        for t in range(1, steps + 1 if len(text) else 1):
            pick = rng.integers(0, len(text), batch)
            ids, target, weight = frames(stream, len(self.of) - 1, begin[pick], first[pick], sizes[text[pick]])
            _, grad, dx = self.loss(ids, self.of[target].astype(np.int64), weight)
            self._step(moments, grad, t, rate * min(1, t / 50) * (1 - 0.9 * t / steps))
            used, at = np.unique(ids.reshape(-1), return_inverse=True)
            own = np.zeros((len(used), WIDTH), np.float32)
            np.add.at(own, at.reshape(-1), dx)
            self._step_own(moments, used, own, t, rate * (1 - 0.9 * t / steps))
        self.table = None
        return self

    def _step_own(self, moments: dict, used: np.ndarray, own: np.ndarray, t: int, rate: float) -> None:
        m, s = moments["own"]  # moments and values of the ids at hand only
        m[used] += 0.1 * (own - m[used])
        s[used] += 0.01 * (own * own - s[used])
        self.p["own"][used] -= np.float32(rate) * m[used] / (np.sqrt(s[used] / (1 - 0.99**t)) + np.float32(1e-6))

    def _step(self, moments: dict, grad: dict[str, np.ndarray], t: int, rate: float) -> None:
        for n, g in grad.items():
            m, s = moments[n]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            self.p[n] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def learn(self, stream: np.ndarray, sizes: np.ndarray, words: int, state: dict, words_per_step: int, chunk: int = 256, rate: float = 0.002) -> None:
        """Every target of the texts (``words`` together) once, in windows in random order: a step for each ``words_per_step``, with
        the mean gradient of all targets since the last. ``state`` carries gradients and moments on; ``learn_rest`` ends it."""
        rng = state.setdefault("rng", np.random.default_rng(3))
        n = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), n)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        begin, order = (np.cumsum(sizes) - sizes)[text], rng.permutation(len(text))
        each = words / max(1, len(text))  # words of a window
        chunk = int(np.clip(words_per_step / each if each else chunk, 1, chunk))
        if "sum" not in state:
            state |= {"sum": {n: np.zeros(x.shape) for n, x in self.p.items()}, "weight": 0.0, "owed": 0.0, "words": 0.0, "t": 0, "used": [], "times": np.zeros(len(self.of), np.float32)}
            state["moments"] = {n: (np.zeros_like(x), np.zeros_like(x)) for n, x in self.p.items()}
        for lo in range(0, len(text), chunk):
            pick = order[lo : lo + chunk]
            ids, target, weight = frames(stream, len(self.of) - 1, begin[pick], first[pick], sizes[text[pick]])
            _, grad, dx = self.loss(ids, self.of[target].astype(np.int64), weight)
            here = float(weight.sum())
            for name, g in grad.items():
                state["sum"][name] += g * here
            flat = ids.reshape(-1)
            at = np.argsort(flat, kind="stable")
            used = np.flatnonzero(np.concatenate(([True], np.diff(flat[at]) != 0)))
            state["used"].append(flat[at[used]])
            state["sum"]["own"][flat[at[used]]] += np.add.reduceat(dx[at], used) * here
            state["weight"] += here
            state["owed"] += each * len(pick)
            if state["owed"] >= words_per_step:
                self._learned(state, rate, state["owed"])

    def learn_rest(self, state: dict, words_per_step: int, rate: float = 0.002) -> None:
        """A step for what ``learn`` has seen since the last one, the shorter the less it was."""
        if state.get("weight"):
            self._learned(state, rate * min(1.0, state["owed"] / words_per_step), state["owed"])

    def _learned(self, state: dict, rate: float, words: float) -> None:
        state["t"] += 1
        t, total, moments = state["t"], state["sum"], state["moments"]
        rate *= min(1, t / 20)
        self._step(moments, {n: total[n] / state["weight"] for n in SHARED}, t, rate)
        used = np.unique(np.concatenate(state["used"]))
        self._step_own(moments, used, total["own"][used] / state["weight"], t, rate)
        state["times"][used] += 1
        total["own"][used] = 0
        for n in SHARED:
            total[n][:] = 0
        state["words"] += words
        state["weight"], state["owed"], state["used"] = 0.0, 0.0, []

    def score(self, stream: np.ndarray, sizes: np.ndarray, stops: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Of every element of ``stream``, each from the one window that scores it: log10 P(class | context), and log10 of the mass of classes in ``stops``."""
        out, stop = np.zeros(len(stream), np.float32), np.zeros(len(stream), np.float32)
        text, first, scored = windows(sizes)
        begin, size = (np.cumsum(sizes) - sizes)[text], sizes[text]
        sums = np.stack((np.ones(CLASSES), stops), 1).astype(np.float32)
        scale = np.float32(1 / np.log(10))
        for lo in range(0, len(text), chunk):
            part = slice(lo, lo + chunk)
            ids, target, _ = frames(stream, len(self.of) - 1, begin[part], first[part], size[part])
            z = self.hidden(ids)
            at = first[part, None] + np.arange(WINDOW)[None]
            row, col = np.nonzero((at >= scored[part, None]) & (at < size[part, None]))
            logits = z[row, col] @ self.p["out"]
            logits += self.p["bias"]
            if logits.max() > SAFE:
                logits -= logits.max(1, keepdims=True)
            hit = logits[np.arange(len(row)), self.of[target[row, col]]]
            np.exp(logits, out=logits)
            total = np.log(np.maximum(logits @ sums, np.float32(1e-30)))
            place = begin[part][row] + at[row, col]
            out[place] = (hit - total[:, 0]) * scale
            stop[place] = (total[:, 1] - total[:, 0]) * scale
        return out, stop


def frames(stream: np.ndarray, end: int, begin: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (id before each target; the end id before the first), targets and validity of windows."""
    at = first[:, None] + np.arange(WINDOW)[None]
    ok = at < size[:, None]
    place = begin[:, None] + np.minimum(at, size[:, None] - 1)
    ids = np.where(at > 0, stream[np.maximum(place - 1, 0)], end)
    return ids, stream[place], ok.astype(np.float32)
