"""Word shingles, their hashed sets and fingerprints, vectorised over slices of rows.

Normal form of a text: lower case, canonical decomposition without the combining marks; words are the longest
runs of a-z and 0-9; a shingle is `width` consecutive words. Shingles are 56-bit hashes; equal shingles of a text
count once. A null, empty or short text has no shingle.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Rows hashed at once; at most 256, as a row number takes eight bits beside the hash.
SLICE_ROWS = 256
_MASK56 = np.uint64((1 << 56) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _combining() -> np.ndarray:
    return np.fromiter((unicodedata.combining(chr(i)) != 0 for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(texts: list[str | None], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes): the distinct shingles of each text, sorted by row, then hash."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = "\0".join([(t or "").replace("\0", " ") for t in texts]).lower()
    if not joined.isascii():
        joined = unicodedata.normalize("NFD", joined)
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        high = np.flatnonzero(c > 127)
        b = c.astype(np.uint8)
        b[high] = 32
        drop = high[_combining()[c[high]]]
        b = np.delete(b, drop) if len(drop) else b
    else:
        b = np.frombuffer(joined.encode("ascii"), np.uint8)
    if not len(b):
        return none
    word = ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57))
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(first) < width:
        return none
    size = 1 << max(16, int(len(b)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(np.where(word, (b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], np.uint64(0)), out=total[1:])
    words = mix((total[last] - total[first]) * down[first])
    row = np.searchsorted(np.flatnonzero(b == 0), first)
    n = len(first) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    keep = row[:n] == row[width - 1 :]
    both = np.sort((row[:n][keep].astype(np.uint64) << np.uint64(56)) | (h[keep] & _MASK56))
    if len(both) > 1:
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return (both >> np.uint64(56)).astype(np.int64), both & _MASK56


@lru_cache(maxsize=8)
def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(rows: np.ndarray, hashes: np.ndarray, functions: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, minima): for each row with a shingle, a 64-bit hash of its set and the minima of its set under each function."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((functions, 0), np.uint32)
    node = np.add.reduceat(mix(hashes), starts)
    x = mix(hashes).astype(np.uint32)
    a, b = _functions(functions, seed)
    minima = np.empty((functions, len(starts)), np.uint32)
    for j in range(functions):
        minima[j] = np.minimum.reduceat(x * a[j] + b[j], starts)
    return rows[starts], node, minima


def fingerprint(minima: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: one bit of each of the first 64 minima. Bits of two sets differ with probability (1 - similarity) / 2."""
    bits = ((minima[:64] * np.uint32(0x85EBCA6B)) >> np.uint32(31)).astype(np.uint64)
    out = np.zeros(minima.shape[1], np.uint64)
    for j in range(64):
        out |= bits[j] << np.uint64(j)
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))
