"""Word hashes of whole Arrow columns by array arithmetic.

Words are the runs of bytes other than ASCII white space (0x20, 0x09-0x0D), with A-Z in lower
case.  A word's hash is a polynomial of its bytes modulo 2**64, taken as a difference of running
sums and then mixed, so a batch costs a few array passes and no Python step for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPAN = 1 << 20
_M = 0x9E3779B97F4A7C55 | 1
_INV = pow(_M, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += np.uint64(1)
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words that are letters only: A-Z, a-z and all bytes of longer UTF-8 characters.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_TABLE: dict[str, np.ndarray] = {}
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is overwritten."""
    with np.errstate(over="ignore"):
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(29)
        x *= U(0xC2B2AE3D27D4EB4F)
        x ^= x >> U(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLE.get("p", ())) < n:
        for key, base in (("p", _M), ("i", _INV)):
            t = np.ones(1, U)
            while len(t) < n:
                with np.errstate(over="ignore"):
                    t = np.concatenate([t, t * U(pow(base, len(t), 1 << 64))])
            _TABLE[key] = t
    return _TABLE["p"], _TABLE["i"]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _span(data: np.ndarray, cuts: np.ndarray, kind: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word; no word crosses a cut.  With prefixes the hash has a column for each of them too, 0 for shorter words."""
    n = len(data)
    power, inverse = _powers(max(n, SPAN))
    word = kind[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(_LOWER[data] * power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        if not prefixes:
            return mix(h), starts, ends
        cols = [mix(h)]
        for p in prefixes:
            long = ends - starts >= p
            x = mix((total[np.minimum(starts + p, n)] - total[starts]) * inverse[starts] + U(p))
            cols.append(np.where(long, x, U(0)))
    return np.stack(cols, axis=1), starts, ends


def word_hashes(col: pa.Array, kind: np.ndarray = _WORD, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, at): words of row i are at[i]:at[i+1]; starts and ends are bytes of the column."""
    data, offs = column_bytes(col)
    hashes, starts, ends = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + SPAN)
        if hi < n:  # back to a cut between rows, else to white space, else on to the next white space
            k = int(np.searchsorted(offs, hi, "right")) - 1
            if offs[k] > lo:
                hi = int(offs[k])
            else:
                gaps = np.flatnonzero(~kind[data[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:
                    step = SPAN
                    while True:
                        gaps = np.flatnonzero(~kind[data[hi : hi + step]])
                        row = offs[np.searchsorted(offs, hi, "left") :]
                        stop = min(n, hi + int(gaps[0]) + 1 if len(gaps) else n, int(row[0]) if len(row) else n)
                        if len(gaps) or stop < n or hi + step >= n:
                            hi = stop
                            break
                        step *= 2
        h, s, e = _span(data[lo:hi], offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi, "right")] - lo, kind, prefixes)
        hashes.append(h)
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not hashes:
        z = np.empty(0, np.int64)
        return np.empty((0, 1 + len(prefixes)) if prefixes else 0, U), z, z, np.zeros(len(offs), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, offs).astype(np.int64)


def shingles(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, at) of the word n-grams of each row; a shorter row with words gives one of all its words."""
    size = np.diff(at)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    left = np.repeat(at[1:], count) - first
    g = np.zeros(len(first), U)
    padded = np.concatenate([h, np.zeros(n, U)])
    with np.errstate(over="ignore"):
        for j in range(n):
            x = padded[first + j]
            if j and (size < n).any():
                x = np.where(left > j, x, U(0))
            g += x * U((2 * j + 1) * 0xA0761D6478BD642F % (1 << 64) | 1)
    return mix(g), out_at


def word_hash(word: str) -> int:
    """The hash of one word, for tests and small lists."""
    return int(word_hashes(pa.array([word]))[0][0])
