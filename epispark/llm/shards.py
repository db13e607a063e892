"""Text shards: the unit in which the exact-repeat operators look at texts.

Documents are dealt to shards of about ``shard_bytes`` bytes by a hash.  A
shard deduplicates what it holds before anything is shuffled, so a passage,
window or document that is copied any number of times costs at most one row
per shard, and no key gathers more rows than there are shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from epispark.llm.common import map_batches, text_slices

NO_FIRST = np.iinfo(np.int64).max  # no document holds it


def shard_count(docs: DataFrame, text_col: str, shard_bytes: int) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / shard_bytes))


def sharded(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """Rows ``_shard``, ``_id`` (long, may be null) and ``_z`` (the text's
    UTF-8 bytes, zstd-compressed; empty for a null text)."""
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    source = source.select(F.pmod(F.xxhash64("_id", "_t"), F.lit(shards)).alias("_shard"), "_id", "_t")

    def squeeze(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in text_slices(batches, "_t"):
            texts = batch.column(2).fill_null("").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packer.compress(t) for t in texts], pa.binary())],
                                             names=["_shard", "_id", "_z"])

    return map_batches(source, squeeze, "_shard long, _id long, _z binary")


def texts_of(shard: pa.Table) -> tuple[pa.Array, list[bytes]]:
    """Ids and texts (as bytes) of a shard's rows."""
    opener = zstandard.ZstdDecompressor()
    ids = shard.column("_id").combine_chunks()
    return ids, [opener.decompress(z) for z in shard.column("_z").to_pylist()]


def slices(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array of bytes, and where each text starts (and the last ends)."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return raw, np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]


def least_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the least and the largest of their values."""
    if not len(keys):
        return keys, values, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[cut], np.minimum.reduceat(values, cut), np.maximum.reduceat(values, cut)


def found_in(needles: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each needle in the sorted ``keys`` (binary search), or -1."""
    if not len(keys):
        return np.full(len(needles), -1)
    at = np.minimum(np.searchsorted(keys, needles), len(keys) - 1)
    return np.where(keys[at] == needles, at, -1)


def bounds(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as sources and as readers: a null id never comes first (it sorts
    last as a source) and nothing comes before it (it sorts first as a
    reader)."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    plain = ids.fill_null(0).to_numpy()
    return np.where(null, NO_FIRST, plain), np.where(null, np.iinfo(np.int64).min, plain)


def covered_by(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Flags of ``n`` positions that lie in a window of ``size``; ``starts``
    are distinct and every window fits."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    padded = np.r_[False, flags, False]
    turn = np.flatnonzero(padded[1:] != padded[:-1])
    return turn[::2], turn[1::2]
