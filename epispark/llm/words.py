"""Vectorised words and hashes of Arrow text columns.

Everything here works on one Arrow batch inside a task: the UTF-8 bytes of
the batch are viewed as one numpy array, so no Python object is made per
word.  Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = _U64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_BASE_INV = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the result."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs never
    cross a row's end.  ``is_word`` holds one flag per byte."""
    n = len(is_word)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(n + 1, dtype=bool)
    first[0] = True
    np.logical_not(is_word, out=first[1:])
    first[offsets] = True
    starts = np.flatnonzero(first[:-1] & is_word)
    last = np.empty(n + 1, dtype=bool)
    np.logical_not(is_word, out=last[:-1])
    last[-1] = True
    last[offsets] = True
    ends = np.flatnonzero(last[1:] & is_word) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def space_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row."""
    return spans(~_SPACE[raw], offsets)


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes (polynomial over the bytes, mixed)."""
    if len(starts) == 0:
        return np.zeros(0, _U64)
    lengths = ends - starts
    # Word bytes only, packed; reduceat then sums each word's own bytes.
    at = np.cumsum(lengths) - lengths
    rel = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    where = rel + np.repeat(starts, lengths)
    terms = _BYTE_CODE[raw[where]] * powers(_BASE, int(lengths.max()))[rel]
    return mix(np.add.reduceat(terms, at) + lengths.astype(_U64))


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` consecutive codes (mixed)."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, _U64)
    sums = np.zeros(len(codes) + 1, dtype=_U64)
    np.cumsum(codes * powers(_BASE, len(codes)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(_BASE_INV, n))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    if len(x) < size:
        return x[:0]
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def inside(rows: np.ndarray, size: int) -> np.ndarray:
    """Flags of the windows of ``size`` items that lie within one row."""
    return rows[:-size + 1] == rows[size - 1:] if len(rows) >= size else np.zeros(0, bool)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Flags of ``n`` positions that lie in one of the windows."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0
