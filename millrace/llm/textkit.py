"""Vectorised text primitives shared by the training-data operators.

Everything works on the raw UTF-8 buffers that Arrow hands over, so no Python
string is made for a word.  A word is ``[^\\x20\\x09-\\x0D]+``; both separators
are ASCII, hence byte positions and word limits agree with code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of plain words: every ASCII sign but letters and digits.
PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: Odd multipliers of the rolling hashes; one lane each.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x *= _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_utf8()) if not pa.types.is_large_string(arr.type) else arr
    n = len(arr)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64, count=n + 1 + arr.offset)[arr.offset :] if n else np.zeros(1, np.int64)
    lo, hi = int(off[0]), int(off[-1])
    data = np.frombuffer(bufs[2], dtype=np.uint8)[lo:hi] if bufs[2] is not None and hi > lo else np.zeros(0, np.uint8)
    return data, off - lo


def slices(data: np.ndarray, off: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one longer row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word's number of each row (n + 1 limits)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    in_word = ~sep[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off] = True
    start = in_word.copy()
    start[1:] &= ~in_word[:-1] | first[1:-1]
    end = in_word.copy()
    end[:-1] &= ~in_word[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes (A-Z lowered if asked)."""
    if not len(s):
        return np.zeros(0, U64)
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[: len(data)] = _LOWER[data] if lower else data
    view = np.lib.stride_tricks.as_strided(buf[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))
    n = e - s
    h = mix(n.astype(U64) * U64(BASES[0]))
    live, k = None, 0
    while True:
        if live is None:
            at, left = s, n
        else:
            at, left = s[live] + k, n[live] - k
        v = view[at] & _MASK[np.minimum(left, 8)]
        v = mix(v ^ (U64(BASES[1]) + U64(k)))
        if live is None:
            h = mix(h ^ v)
            live = np.flatnonzero(n > 8)
        else:
            h[live] = mix(h[live] * U64(5) ^ v)
            live = live[n[live] > k + 8]
        k += 8
        if not len(live):
            return h


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POW.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 21:
            _POW[base] = got
    return got[0][:n], got[1][:n]


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2**64, mixed) of every ``width`` consecutive word hashes."""
    n = len(h)
    if n < width:
        return np.zeros(0, U64)
    up, down = _powers(base, n)
    p = np.zeros(n + 1, U64)
    np.cumsum(h * up, out=p[1:])
    return mix((p[width:] - p[:-width]) * down[: n - width + 1])


def window_starts(limits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers where a whole window starts within its row, and the row of each."""
    counts = np.maximum(np.diff(limits) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + limits[:-1][rows]
    return at, rows
