"""Array-at-a-time text primitives shared by the corpus operators.

Everything here works on the raw UTF-8 bytes of an Arrow string column, so a batch of
documents is tokenised and hashed by a few NumPy passes and no Python string is made.
Offsets are row offsets into one byte buffer; a null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

#: Bytes of text handled by one round of NumPy passes; temporaries are about 60 times this for one very long text.
CHUNK = 1 << 19
#: Rows of one round at most, so that a row's number fits in 16 bits.
ROWS = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for i, b in enumerate((BASE, BASE_INV)):
            t = np.full(size, b, U64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1 + col.offset)[col.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges [i, j) of rows whose texts have about `size` bytes; a longer text is a range of its own, never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n, i + ROWS)
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word of each row) of all words: runs of letters, digits and non-ASCII bytes, ASCII case folded.

    The third array has one more entry than there are rows.
    """
    n = len(buf)
    isw = np.empty(n + 2, bool)
    isw[0] = isw[-1] = False
    isw[1:-1] = _WORD[buf]
    edge = isw[1:] != isw[:-1]
    if len(offsets) > 2:  # a row's end ends a word
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        both = cut[isw[cut] & isw[cut + 1]]
    else:
        both = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    start, end = at[::2], at[1::2]
    pw, inv = _power_tables(n + 1)
    acc = np.zeros(n + 1, U64)
    np.cumsum((_LOWER[buf].astype(U64) + U64(1)) * pw[:n], out=acc[1:])
    h = mix((acc[end] - acc[start]) * inv[start])
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return h, row, first


_SHIFT = [U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3), U64(0x1D8E4E27C47D124F), U64(0xEB44ACCAB455D165), U64(0x9FB21C651E98DF25)]


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first shingle of each row) of all runs of k words; a row of 1 to k - 1 words has one shingle of them all."""
    n, rows = len(h), len(first) - 1
    count = np.diff(first)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    acc = np.zeros(n, U64)
    for t in range(min(k, n)):
        acc[: n - t] += h[t:] * _SHIFT[t % 8] if t == 0 else (h[t:] ^ U64(t)) * _SHIFT[t % 8]
    short = np.flatnonzero((count > 0) & (count < k))
    for r in short:  # sums that would run into the next row
        s, e = first[r], first[r + 1]
        acc[s] = np.sum((h[s:e] ^ np.arange(e - s).astype(U64)) * np.array([_SHIFT[t % 8] for t in range(e - s)], U64), dtype=U64) + U64(e - s)
    keep = np.ones(n, bool)
    have = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(rows), count)
    keep = (np.arange(n) - first[row]) < have[row]
    return mix(acc[keep]), row[keep], np.concatenate([[0], np.cumsum(have)])


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32) * 2 - 1


def simhash(h: np.ndarray, row: np.ndarray, rows: int, words64: int) -> np.ndarray:
    """SimHash of words64 * 64 bits per row: the sign of the sum of the features' +-1 bit vectors.

    The sum is had from one histogram of hash bytes per byte position times the table of a
    byte's bits, so a feature costs words64 * 8 counts and not words64 * 64 additions. A tied
    sum counts as 0, as does a row without features.
    """
    out = np.zeros((rows, words64), U64)
    base = row * 256
    for w in range(words64):
        x = h if w == 0 else mix(h + U64((w * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        b = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
        for p in range(8):
            hist = np.bincount(base + b[:, p], minlength=rows * 256).reshape(rows, 256)
            bits = (hist.astype(np.float32) @ _BITS) > 0
            out[:, w] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(U64) << U64(8 * p)
    return out


def distinct_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row (cut to 48 bits and mixed anew), by one sort: the row's number takes the low 16 bits."""
    low = U64(0xFFFF)
    key = np.sort((h & ~low) | row.astype(U64))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return mix(key & ~low), (key & low).astype(np.int64)


def word_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each row, as words() has them."""
    isw = _WORD[buf]
    start = isw.copy()
    start[1:] &= ~isw[:-1]
    cut = offsets[:-1]
    cut = cut[cut < len(buf)]
    start[cut] = isw[cut]
    acc = np.concatenate([[0], np.cumsum(start)])
    return np.diff(acc[offsets])
