"""Vectorised text kernels: Arrow string columns to word and shingle hashes, without a Python object per word.

Words are hashed with a polynomial over the bytes modulo 2**64 (random value per byte, ASCII capitals folded),
finished with a 64-bit mixer. All arithmetic wraps on purpose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}

# Byte classes of the word definitions.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values() -> np.ndarray:
    if "bytes" not in _TABLES:
        t = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
        t[65:91] = t[97:123]
        _TABLES["bytes"] = t
    return _TABLES["bytes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _TABLES or len(_TABLES["p"]) < n:
        size = max(1 << 21, n)
        for name, base in (("p", _P), ("q", _PINV)):
            t = np.full(size, base, U64)
            t[0] = 1
            _TABLES[name] = np.cumprod(t)
    return _TABLES["p"], _TABLES["q"]


def forget_tables() -> None:
    """Drop the tables of powers, which a driver that has fitted a model does not need any more."""
    _TABLES.clear()


def classes(kind: str) -> np.ndarray:
    """256 booleans: which bytes belong to a word. ``space``: all but ASCII white space. ``alnum``: ASCII letters, digits and all beyond ASCII."""
    if kind not in _TABLES:
        t = np.ones(256, bool)
        if kind == "space":
            t[list(SPACE_BYTES)] = False
        else:
            t[:128] = False
            for a, b in ((48, 58), (65, 91), (97, 123)):
                t[a:b] = True
        _TABLES[kind] = t
    return _TABLES[kind]


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, limit: int = 1 << 21):
    """Row ranges whose bytes stay near ``limit``; a longer row is a block of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of a block of texts. ``hash``: one value a word; ``first``: index of each text's first word (n + 1 entries)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: str = "space"):
        n = len(raw)
        inside = classes(kind)[raw]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        cut = offsets[:-1][offsets[:-1] < n]
        before[cut] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = offsets[1:]
        after[last[last > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        p, q = _powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_byte_values()[raw] * p[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(U64))
        self.counts = np.diff(self.first)


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (order matters)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out *= U64(0x2545F4914F6CDD1D)
        out += words[j : j + n]
    return mix(out)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; fewer words: the whole sequence as one; none: empty."""
    allh, out = window_hash(words.hash, k), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            s = np.sort(allh[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif n:
            out.append(window_hash(words.hash[a:b], n))
        else:
            out.append(allh[:0])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
