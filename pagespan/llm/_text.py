"""Vectorised byte kernels shared by the text operators.

A block of texts is handled as one numpy byte array. Words are the maximal runs
of bytes outside [\\x20\\x09-\\x0D]; A-Z are lower-cased, all other bytes stay.
A word's hash is a polynomial over a random byte table, taken from prefix sums
modulo 2**64, then mixed, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_up = np.arange(ord("A"), ord("Z") + 1)
BYTE_VALUE[_up] = BYTE_VALUE[_up + 32]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    while len(_pow) < n:
        k = len(_pow)
        _pow = np.concatenate([_pow, _pow * U64(pow(_B, k, 1 << 64))])
        _inv = np.concatenate([_inv, _inv * U64(pow(_B_INV, k, 1 << 64))])
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; another seed gives another order."""
    x = x.astype(U64, copy=True)
    if seed:
        x ^= U64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted. By sorting: for long arrays of mostly distinct values that is several times faster than the
    hash table behind np.unique, and needs half of its memory."""
    x = np.sort(x)
    if len(x) > 1:
        new = np.empty(len(x), bool)
        new[0] = True
        np.not_equal(x[1:], x[:-1], out=new[1:])
        if not new.all():
            x = x[new]
    return x


def slices(n: int, size: int = 1 << 20) -> Iterator[slice]:
    """Cuts 0..n, so that the temporary arrays of a long text's arithmetic stay small."""
    return (slice(a, min(a + size, n)) for a in range(0, n, size))


class Words:
    """Words of a block: start and end bytes, hashes, and for text i the words first[i]:first[i+1].

    A long text is read in pieces that end at white space, so that what is kept per word is all that grows with it."""

    __slots__ = ("data", "off", "start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        if len(data) <= 2 * BLOCK_BYTES:
            self.start, self.end, self.hash = _words(data, off)
        else:
            kind = np.int32 if len(data) < 1 << 31 else np.int64
            parts = []
            for a, b in _cuts(data):
                own = off[np.searchsorted(off, a, "left") : np.searchsorted(off, b, "right")] - a
                start, end, h = _words(data[a:b], np.concatenate([[0], own, [b - a]]))
                parts.append(((start + a).astype(kind), (end + a).astype(kind), h))
            self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first = np.searchsorted(self.start, off)


def _cuts(data: np.ndarray):
    """Bounds of pieces of about BLOCK_BYTES; each but the last ends behind white space."""
    n, a = len(data), 0
    while a < n:
        b = min(a + BLOCK_BYTES, n)
        while b < n and not IS_SPACE[data[b - 1]]:
            ahead = np.flatnonzero(IS_SPACE[data[b : b + BLOCK_BYTES]])
            b = b + int(ahead[0]) + 1 if len(ahead) else min(b + BLOCK_BYTES, n)
        yield a, b
        a = b


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    space = IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    word = ~space
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    p, inv = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[data] * p[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inv[start]
    return start, end, mix(h ^ (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def words_of(texts: list[str | bytes | None]) -> Words:
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=off[1:])
    return Words(np.frombuffer(b"".join(raw), np.uint8), off)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Cuts a string column into blocks of about BLOCK_BYTES (one text at least), without copying; null is empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


_C = [U64(mult | 1) for mult in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37)]


def shingles(w: Words, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; fewer words: the whole sequence as one; none: empty."""
    h, first = w.hash, w.first
    m = len(h)
    s = np.empty(max(m - k + 1, 0), U64)
    for part in slices(len(s)):
        x = np.zeros(part.stop - part.start, U64)
        for j in range(k):
            x += h[part.start + j : part.stop + j] * U64(int(_C[j % 5]) * (2 * (j // 5) + 1) & (2**64 - 1))
        s[part] = mix(x)
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        n = b - a
        if n >= k:
            out.append(distinct(s[a : b - k + 1]))
        elif n:
            x = U64(n)
            with np.errstate(over="ignore"):
                for v in h[a:b]:
                    x = x * U64(0x9FB21C651E98DF25) + v
            out.append(mix(np.array([x], U64), 77 + int(n)))
        else:
            out.append(np.zeros(0, U64))
    return out
