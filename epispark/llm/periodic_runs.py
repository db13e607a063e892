"""Periodic run detection (operator 11).

A run is a maximal stretch of words that repeats with a smallest period, at
least ``least_repeats`` times over.  Recursive frequency splitting comes first:
every word of a qualifying run occurs in it at least ``least_repeats`` times,
so a word that occurs more rarely within its segment splits the segment there;
the parts are counted again until none splits.  The surviving segments are
scanned for lags: for each power of two m, the next place of equal windows of
m words gives the periods above m / 2 and up to m, because within a run windows
as long as the period recur at exactly the period.  A scan costs n log n words
compared, whatever the periods are.

Texts never shuffle: the work is one map over the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from epispark.llm.common import map_batches, text_slices
from epispark.llm.words import space_words, text_bytes, word_codes


def split_rare(words: np.ndarray, rows: np.ndarray, least: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that survive the splitting, ascending, and their segments.

    ``words`` are numbers below their count, ``rows`` ascending documents.  A
    segment without a rare word is stable and set aside; the others are cut at
    their rare words, parts under ``shortest`` words are dropped, and what is
    left is counted again."""
    at, segment, base = np.arange(len(words)), rows.astype(np.int64), len(words) + 1
    stable: list[np.ndarray] = []
    while len(at):
        _, group, counts = np.unique(segment * base + words[at], return_inverse=True, return_counts=True)
        rare = counts[group] < least
        edge = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        changed = np.repeat(np.logical_or.reduceat(rare, edge), np.diff(np.r_[edge, len(at)]))
        stable.append(at[~changed])
        left = changed & ~rare
        at, segment = at[left], segment[left]
        if not len(at):
            break
        start = np.r_[True, (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])]
        segment = np.cumsum(start) - 1
        long = np.bincount(segment) >= shortest
        at, segment = at[long[segment]], segment[long[segment]]
    at = np.sort(np.concatenate(stable)) if stable else np.zeros(0, np.int64)
    # Segments that touch within a row are none: a rare word lies between two.
    start = np.r_[True, (at[1:] != at[:-1] + 1) | (rows[at[1:]] != rows[at[:-1]])][:len(at)]
    return at, np.cumsum(start) - 1


def lag_scan(words: np.ndarray, segment: np.ndarray, least_repeats: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (index), length and period of every run within the segments."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    index, m = np.arange(len(words)), 1
    ids = words.astype(np.int64)
    while True:
        # Periods of this round are above m // 2; shorter segments are done.
        sizes = np.bincount(segment) if len(segment) else np.zeros(0, np.int64)
        held = sizes[segment] >= max(shortest, least_repeats * (m // 2 + 1)) if len(segment) else np.zeros(0, bool)
        index, ids, segment = index[held], ids[held], segment[held]
        if not len(index):
            break
        edge = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sizes = np.diff(np.r_[edge, len(index)])
        segment = np.repeat(np.arange(len(edge)), sizes)
        end = np.repeat(edge + sizes, sizes)
        whole = np.flatnonzero(np.arange(len(index)) + m <= end)  # windows inside their segment
        key = segment[whole] * (int(ids.max()) + 1) + ids[whole]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        lag = np.zeros(len(index), np.int64)
        lag[whole[order[:-1][same]]] = (whole[order[1:]] - whole[order[:-1]])[same]
        hit = np.flatnonzero((lag > m // 2) & (lag <= m))
        if len(hit):
            first = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (lag[hit[1:]] != lag[hit[:-1]])])
            last = np.r_[first[1:], len(hit)] - 1
            period = lag[hit[first]]
            length = hit[last] - hit[first] + m + period
            enough = length >= np.maximum(shortest, least_repeats * period)
            found.append((index[hit[first[enough]]], length[enough], period[enough]))
        # Windows twice as long, numbered by the pair of their halves.
        pair = np.flatnonzero(np.arange(len(index)) + 2 * m <= end)
        _, number = np.unique(ids[pair] * (int(ids.max()) + 1) + ids[pair + m], return_inverse=True)
        ids = np.zeros(len(index), np.int64)
        ids[pair] = number
        m *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    """The words of every row joined by one space."""
    last = np.r_[rows[1:] != rows[:-1], True][:len(rows)]
    sizes = ends - starts + ~last
    at = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    shift = np.repeat(starts - at, sizes)
    shift += np.arange(total)
    out = raw[np.minimum(shift, len(raw) - 1)] if total else np.zeros(0, np.uint8)
    out[(at + sizes - 1)[~last]] = 0x20
    edge = np.zeros(n_rows + 1, np.int64)
    np.add.at(edge, rows + 1, sizes)
    return pa.Array.from_buffers(pa.large_string(), n_rows, [None, pa.py_buffer(np.cumsum(edge)), pa.py_buffer(out)]).cast(pa.string())


def runs_of(column: pa.Array, least_repeats: int, shortest: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Word counts, runs and collapsed texts of a column of texts."""
    raw, offsets = text_bytes(column)
    starts, ends, rows = space_words(raw, offsets)
    _, words = np.unique(word_codes(raw, starts, ends), return_inverse=True)
    at, segment = split_rare(words, rows, least_repeats, shortest)
    start, length, period = lag_scan(words[at], segment, least_repeats, shortest)
    start = at[start]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    counts = np.bincount(rows, minlength=len(column))
    first = np.cumsum(counts) - counts
    owner = rows[start]
    per_row = np.bincount(owner, minlength=len(column))
    items = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)].astype(np.int32)), items)
    return pa.array(counts.astype(np.int64)), runs, _joined(raw, starts[kept], ends[kept], rows[kept], len(column))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_repeats: int = 4, shortest: int = 6) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``runs`` (an array of
    ``start, length, period`` in words, by start, then period) and
    ``collapsed`` (the words that no run holds after its first period, joined
    by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; two are equal if their
    64-bit hashes are.  A run is a stretch with smallest period q that no
    neighbouring word extends, of at least ``shortest`` and
    ``least_repeats * q`` words (``least_repeats`` is 3 or more, else windows
    need not recur in it).  Runs may overlap, and all are reported.

    A null or empty text has no words, no runs and an empty collapsed text.
    Rows are judged alone, so null and repeated ids, repeated rows and ties
    change nothing; other columns are not read; an empty table gives no rows.
    A text is held whole by one task, with some tens of bytes per byte.
    """
    if least_repeats < 3:
        raise ValueError("least_repeats must be 3 or more")
    source = docs.select(id_col, text_col)

    def run(batches):
        for batch in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(0), *runs_of(batch.column(1), least_repeats, shortest)], names=[id_col, "n_words", "runs", "collapsed"])

    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    return map_batches(source, run, T.StructType([source.schema[0], T.StructField("n_words", T.LongType()), T.StructField("runs", run_type),
                                                  T.StructField("collapsed", T.StringType())]))
