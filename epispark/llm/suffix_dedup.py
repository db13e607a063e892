"""Suffix-array dedup of byte strings (operator 9).

Which 50-byte strings also start in an earlier document?  Three steps, each a
group-by over shards:

1. Every 50-byte window has an anchor: its least hash of a 16-byte gram.
   Equal windows have equal anchors, so windows whose anchor occurs in one
   document only cannot repeat and are left aside.  Neighbouring windows with
   one anchor form a piece of text; pieces go to buckets by anchor, so equal
   windows meet in one bucket.
2. Each bucket sorts the suffixes of its distinct pieces (Larsson-Sadakane
   refinement in numpy: ranks at 8, 16, 32 and then 50 bytes, only groups that
   are still tied, only suffixes that are long enough).  A group of equal rank
   is a string; its least document is kept.
3. Each document shard finds its own pieces among the buckets' answers by
   binary search and marks the bytes to remove.

Anchors with very many occurrences send their windows one by one, dealt by
the window's own bytes, so that a common phrase in many contexts spreads over
all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from epispark.llm import shards as S
from epispark.llm.words import mix, sliding_min

_U64 = np.uint64
GRAM = 16
LONGEST = 64  # windows in a piece


def _eights(raw: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes that start at every position, as one number."""
    n = max(len(raw) - 7, 0)
    out = np.empty(n, dtype=_U64)
    for o in range(min(8, n)):
        part = raw[o:o + (len(raw) - o) // 8 * 8].view(order)
        out[o::8] = part[:len(out[o::8])]
    return out


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes that start at every position."""
    eight = _eights(raw)
    x = eight[:-8] * _U64(0x9E3779B97F4A7C15) + eight[8:] * _U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(29)
    x *= _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


def _pieces(raw: np.ndarray, offsets: np.ndarray, size: int):
    """Pieces of the texts: first byte, number of windows, anchor, row."""
    if len(raw) < size:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U64), z
    anchor = sliding_min(_grams(raw), size - GRAM + 1)
    n = len(anchor)
    whole = np.ones(n, dtype=bool)  # windows that do not cross a text's end
    for end in offsets[1:-1]:
        whole[max(end - size + 1, 0):end] = False
    turn = np.empty(n + 1, dtype=bool)
    turn[0] = turn[-1] = True
    np.not_equal(anchor[1:], anchor[:-1], out=turn[1:-1])
    turn[1:-1] |= whole[1:] != whole[:-1]
    inner = offsets[1:-1]
    turn[inner[inner < n]] = True
    cut = np.flatnonzero(turn)
    first, count = cut[:-1], np.diff(cut)
    keep = whole[first]
    first, count = first[keep], count[keep]
    if len(count) and count.max() > LONGEST:
        parts = -(-count // LONGEST)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + nth * LONGEST, np.minimum(np.repeat(count, parts) - nth * LONGEST, LONGEST)
    # A least hash is a small number; mixing spreads anchors over the buckets.
    return first, count, mix(anchor[first]), np.searchsorted(offsets, first, side="right") - 1


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> _U64(32)).astype(np.int64) * buckets >> 32


def _planes(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane (compresses)."""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(_U64).ravel(), dtype=_U64)


def _anchor_rows(size: int, buckets: int):
    """A shard's distinct anchors, packed per bucket: the anchors, and how
    often each occurs (negative: in several documents)."""
    def run(shard: pa.Table) -> pa.Table:
        ids, texts = S.texts_of(shard)
        source, _ = S.bounds(ids)
        keys, own = [np.zeros(0, _U64)], [np.zeros(0, np.int64)]
        for a, b in S.slices(texts):
            raw, offsets = S.joined(texts[a:b])
            _, _, anchor, row = _pieces(raw, offsets, size)
            keys.append(anchor)
            own.append(source[row + a])
        keys, own = np.concatenate(keys), np.concatenate(own)
        key, least, most = S.least_by(keys, own)
        times = np.diff(np.r_[np.searchsorted(np.sort(keys), key), len(keys)]).clip(max=1 << 30).astype(np.int32)
        times = np.where(least < most, -times, times).astype("<i4")
        bucket = _bucket(key, buckets)
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(key) else np.zeros(0, np.int64)
        ends = np.r_[cut[1:], len(key)]
        where = shard.column("_shard")[0].as_py()
        return pa.table({"_bucket": pa.array(bucket[cut], pa.int64()), "_shard": pa.array([where] * len(cut), pa.int64()),
                         "anchors": pa.array([_planes(key[s:e]) for s, e in zip(cut, ends)], pa.binary()),
                         "times": pa.array([times[s:e].tobytes() for s, e in zip(cut, ends)], pa.binary())})
    return run


def _repeated_rows(split_above: int):
    """Per shard, the bucket's anchors that occur in several documents, those
    with more than ``split_above`` occurrences marked apart."""
    def run(bucket: pa.Table) -> pa.Table:
        keys = [_unplanes(a) for a in bucket.column("anchors").to_pylist()]
        times = [np.frombuffer(t, "<i4") for t in bucket.column("times").to_pylist()]
        every, count = np.concatenate(keys), np.concatenate(times).astype(np.int64)
        order = np.argsort(every, kind="stable")
        key, count = every[order], count[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        held = np.diff(np.r_[cut, len(key)])
        repeats = (held > 1) | (np.minimum.reduceat(count, cut) < 0) if len(cut) else np.zeros(0, bool)
        many = np.add.reduceat(np.abs(count), cut) > split_above if len(cut) else repeats
        key, many = key[cut][repeats], many[repeats]
        shard, own, apart = [], [], []
        for where, mine in zip(bucket.column("_shard").to_pylist(), keys):
            at = S.found_in(mine, key)
            hit = at >= 0
            if hit.any():
                shard.append(where)
                own.append(_planes(mine[hit]))
                apart.append(np.packbits(many[at[hit]]).tobytes())
        return pa.table({"_shard": pa.array(shard, pa.int64()), "anchors": pa.array(own, pa.binary()), "apart": pa.array(apart, pa.binary())})
    return run


def _known(repeated: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [_unplanes(a) for a in repeated.column("anchors").to_pylist()]
    apart = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool) for b, k in zip(repeated.column("apart").to_pylist(), keys)]
    if not keys:
        return np.zeros(0, _U64), np.zeros(0, bool)
    key, apart = np.concatenate(keys), np.concatenate(apart)
    order = np.argsort(key)
    return key[order], apart[order]


def _one_by_one(first, count, anchor, row, split):
    """Pieces, those of split anchors cut into single windows."""
    if not split.any():
        return first, count, anchor, row, split
    parts = np.where(split, count, 1)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    split = np.repeat(split, parts)
    return np.repeat(first, parts) + nth, np.where(split, 1, np.repeat(count, parts)), np.repeat(anchor, parts), np.repeat(row, parts), split


def _piece_rows(size: int, buckets: int):
    """A shard's distinct pieces, packed per bucket, each with the least and
    whether it has another document."""
    def run(shard: pa.Table, repeated: pa.Table) -> pa.Table:
        packed: dict[int, list] = {}
        if shard.num_rows and repeated.num_rows:
            known, apart = _known(repeated)
            ids, texts = S.texts_of(shard)
            source, _ = S.bounds(ids)
            seen: dict[bytes, list] = {}
            for a, b in S.slices(texts):
                raw, offsets = S.joined(texts[a:b])
                first, count, anchor, row = _pieces(raw, offsets, size)
                at = S.found_in(anchor, known)
                hit = np.flatnonzero(at >= 0)
                first, count, anchor, row, split = _one_by_one(first[hit], count[hit], anchor[hit], row[hit], apart[at[hit]])
                data = raw.tobytes()
                for start, n, doc, to, alone in zip(first.tolist(), count.tolist(), source[row + a].tolist(), _bucket(anchor, buckets).tolist(), split.tolist()):
                    string = data[start:start + n + size - 1]
                    if (entry := seen.get(string)) is None:
                        if alone:
                            to = (xxhash.xxh64_intdigest(string) >> 32) * buckets >> 32
                        seen[string] = [doc, 0, to]
                    elif doc != entry[0]:
                        entry[1] = 1
                        if doc < entry[0]:
                            entry[0] = doc
            for string, (doc, several, to) in seen.items():
                packed.setdefault(to, []).append((string, doc, several))
        where = shard.column("_shard")[0].as_py() if shard.num_rows else 0
        packer = zstandard.ZstdCompressor(level=3)
        rows = list(packed.values())
        if shard.num_rows and repeated.num_rows and apart.any():  # the split anchors go back to their shard as they are
            return pa.concat_tables([_packed(list(packed), where, rows, packer), pa.table(
                {"_bucket": [-1 - where], "_shard": [where], "sizes": [b""], "strings": [_planes(known[apart])], "least": [b""], "several": [b""]}, schema=_PACKED)])
        return _packed(list(packed), where, rows, packer)
    return run


_PACKED = pa.schema([("_bucket", pa.int64()), ("_shard", pa.int64()), *[(c, pa.binary()) for c in ("sizes", "strings", "least", "several")]])


def _packed(buckets: list[int], where: int, rows: list, packer) -> pa.Table:
    return pa.table({"_bucket": pa.array(buckets, pa.int64()), "_shard": pa.array([where] * len(rows), pa.int64()),
                     "sizes": pa.array([np.array([len(p[0]) for p in r], "<i4").tobytes() for r in rows], pa.binary()),
                     "strings": pa.array([packer.compress(b"".join(p[0] for p in r)) for r in rows], pa.binary()),
                     "least": pa.array([np.array([p[1] for p in r], "<i8").tobytes() for r in rows], pa.binary()),
                     "several": pa.array([bytes(p[2] for p in r) for r in rows], pa.binary())}, schema=_PACKED)


def suffix_groups(raw: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over the windows of a text of pieces.

    ``ends`` holds, for every byte, the end of its piece.  Returns the first
    bytes of all windows of ``size`` bytes within a piece, in the order of
    their strings, and the rank of each (equal strings, equal ranks).

    Larsson-Sadakane refinement: ranks at depth h, read at p and p + step,
    order the depth h + step; ties alone are sorted again.  Ranks of a depth
    are final before the next one reads them, because shorter tails drop out.
    """
    left = ends - np.arange(len(raw))
    depth = min(8, size)
    if depth < 8:
        raise ValueError("windows of fewer than eight bytes are not supported")
    head = _eights(raw, ">u8")
    live = np.flatnonzero(left >= 8)
    order = live[np.argsort(head[live], kind="stable")]
    rank = np.full(len(raw), -1, dtype=np.int64)
    value = head[order]
    new = np.r_[True, value[1:] != value[:-1]] if len(order) else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    while depth < size:
        step = min(depth, size - depth)
        order = order[left[order] >= depth + step]
        old = rank[order]
        tied = np.zeros(len(order), dtype=bool)
        same = old[1:] == old[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        todo = np.flatnonzero(tied)
        # Sort ties by (rank, rank one step on); the first part keeps groups in place.
        key = old[todo] * np.int64(len(raw) + 1) + rank[order[todo] + step]
        by = np.argsort(key, kind="stable")
        order[todo] = order[todo[by]]
        key = key[by]
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        group = old[todo]
        opens = np.r_[True, group[1:] != group[:-1]] if len(key) else np.zeros(0, bool)
        place = np.arange(len(todo))
        offset = np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(opens, place, 0))
        following = rank.copy()
        following[order[todo]] = group + offset
        rank = following
        depth += step
    return order, rank[order]


def _answer_rows(size: int):
    """Per shard, its pieces in a bucket that an earlier document also has:
    the piece's hash and the least document of each of its windows."""
    def run(bucket: pa.Table) -> pa.Table:
        if bucket.column("_bucket")[0].as_py() < 0:
            return pa.table({"_shard": bucket.column("_shard"), "hashes": bucket.column("strings"), "counts": bucket.column("sizes"),
                             "firsts": bucket.column("least")})
        opener = zstandard.ZstdDecompressor()
        distinct: dict[bytes, int] = {}
        rows = []
        for sizes, strings, least, several in zip(*(bucket.column(c).to_pylist() for c in ("sizes", "strings", "least", "several"))):
            data, at, own = opener.decompress(strings), 0, []
            for n in np.frombuffer(sizes, "<i4").tolist():
                own.append(distinct.setdefault(data[at:at + n], len(distinct)))
                at += n
            rows.append((np.array(own), np.frombuffer(least, "<i8"), np.frombuffer(several, np.uint8)))
        pieces = list(distinct)
        raw, offsets = S.joined(pieces)
        lengths = np.diff(offsets)
        least = np.full(len(pieces), S.NO_FIRST)
        for own, low, _ in rows:
            np.minimum.at(least, own, low)
        order, rank = suffix_groups(raw, np.repeat(offsets[1:], lengths), size)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        first_of = np.full(len(raw), S.NO_FIRST)  # by rank
        np.minimum.at(first_of, rank, least[owner[order]])
        first = np.full(len(raw), S.NO_FIRST)  # by window
        first[order] = first_of[rank]
        begin, count = offsets[:-1], lengths - size + 1
        earliest = np.minimum.reduceat(np.where(np.arange(len(raw)) - np.repeat(begin, lengths) < np.repeat(count, lengths), first, S.NO_FIRST), begin) if len(pieces) else least
        hashes = np.array([xxhash.xxh64_intdigest(p) for p in pieces], dtype=_U64)
        shard, out = [], {"hashes": [], "counts": [], "firsts": []}
        for where, (own, low, several) in zip(bucket.column("_shard").to_pylist(), rows):
            told = own[(earliest[own] < low) | (several > 0)]
            if not len(told):
                continue
            told = told[np.argsort(hashes[told])]
            shard.append(where)
            out["hashes"].append(_planes(hashes[told]))
            windows = [first[b:b + c] for b, c in zip(begin[told].tolist(), count[told].tolist())]
            flat = [w[:1] if (w == w[0]).all() else w for w in windows]  # one value if all are equal
            out["counts"].append(np.array([len(f) for f in flat], "<i2").tobytes())
            out["firsts"].append(np.concatenate(flat).astype("<i8").tobytes())
        return pa.table({"_shard": pa.array(shard, pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})
    return run


_RESULT = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.string()), ("kept", pa.binary())])


class _Answers:
    """What the buckets told a shard: hashes of pieces, and the least
    document of each of their windows (or one for all)."""

    def __init__(self, told: pa.Table):
        hashes, counts, firsts, split = [np.zeros(0, _U64)], [np.zeros(0, "<i2")], [np.zeros(0, "<i8")], [np.zeros(0, _U64)]
        for h, c, f in zip(*(told.column(n).to_pylist() for n in ("hashes", "counts", "firsts"))):
            if c:
                hashes.append(_unplanes(h))
                counts.append(np.frombuffer(c, "<i2"))
                firsts.append(np.frombuffer(f, "<i8"))
            else:
                split.append(_unplanes(h))
        hashes, counts = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
        order = np.argsort(hashes)
        self.hashes, self.counts, self.begins = hashes[order], counts[order], (np.cumsum(counts) - counts)[order]
        self.firsts, self.split = np.concatenate(firsts), np.sort(np.concatenate(split))

    def gone(self, raw, offsets, reader, size: int) -> np.ndarray:
        """First bytes of the windows that an earlier document also has."""
        first, count, anchor, row = _pieces(raw, offsets, size)
        first, count, _, row, _ = _one_by_one(first, count, anchor, row, S.found_in(anchor, self.split) >= 0)
        data, digest = raw.tobytes(), xxhash.xxh64_intdigest
        hashed = np.fromiter((digest(data[s:s + n + size - 1]) for s, n in zip(first.tolist(), count.tolist())), _U64, len(first))
        at = S.found_in(hashed, self.hashes)
        hit = np.flatnonzero(at >= 0)
        first, count, row, at = first[hit], count[hit], row[hit], at[hit]
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        told = np.repeat(self.begins[at], count) + np.where(np.repeat(self.counts[at], count) == 1, 0, nth)
        return (np.repeat(first, count) + nth)[self.firsts[told] < np.repeat(reader[row], count)]


_RESULT = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("spans", pa.string()), ("kept", pa.binary())])


def _removal(size: int):
    def run(shard: pa.Table, told: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return _RESULT.empty_table()
        ids, texts = S.texts_of(shard)
        _, reader = S.bounds(ids)
        answers = _Answers(told)
        spans, removed, kept = [], [], []
        for a, b in S.slices(texts):
            raw, offsets = S.joined(texts[a:b])
            starts = answers.gone(raw, offsets, reader[a:b], size) if told.num_rows else ()
            gone = S.covered_by(starts, size, len(raw)) if len(starts) else np.zeros(len(raw), dtype=bool)
            for i in range(a, b):
                own = slice(offsets[i - a], offsets[i - a + 1])
                begin, end = S.runs(gone[own])
                spans.append([f"{s}:{e}" for s, e in zip(begin, end)])
                removed.append(int((end - begin).sum()))
                kept.append(raw[own][~gone[own]].tobytes() if len(begin) else texts[i])
        return pa.Table.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                                     pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(s) for s in spans], pa.string()),
                                     pa.array(kept, pa.binary())], schema=_RESULT)
    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50,
                 shard_bytes: int = 8 << 20, split_above: int = 50_000) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``spans`` (removed byte runs ``start:end``, comma-joined) and
    ``kept`` (the remaining bytes; a cut may split a character).

    Texts are UTF-8 bytes.  A byte goes if a string of ``size`` (16 or more)
    bytes covers it that also starts in a row with a smaller id; strings do
    not cross rows, may overlap, and are judged on the input.

    A null text is empty; texts shorter than ``size`` stay whole.  A null id
    is never the smaller one and loses nothing; rows with one id do not remove
    from each other; an empty table gives no rows.  ``split_above``: anchors
    with more occurrences send their windows one by one.
    """
    if size < GRAM:
        raise ValueError(f"size must be at least {GRAM}")
    n = S.shard_count(docs, text_col, shard_bytes)
    shards, buckets = S.sharded(docs, id_col, text_col, n).groupBy("_shard"), 3 * n
    anchors = shards.applyInArrow(_anchor_rows(size, buckets), "_bucket long, _shard long, anchors binary, times binary")
    repeated = anchors.groupBy("_bucket").applyInArrow(_repeated_rows(split_above), "_shard long, anchors binary, apart binary")
    pieces = shards.cogroup(repeated.groupBy("_shard")).applyInArrow(
        _piece_rows(size, buckets), "_bucket long, _shard long, sizes binary, strings binary, least binary, several binary")
    answers = pieces.groupBy("_bucket").applyInArrow(_answer_rows(size), "_shard long, hashes binary, counts binary, firsts binary")
    out = shards.cogroup(answers.groupBy("_shard")).applyInArrow(
        _removal(size), "_id long, n_bytes long, n_removed long, n_spans long, spans string, kept binary")
    return out.withColumnRenamed("_id", id_col)
