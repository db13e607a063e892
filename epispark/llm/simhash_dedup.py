"""SimHash near-duplicates with multi-index hashing (operator 10).

Fingerprints are made in Arrow batches; links and groups are joins.  The
unit of linking is the distinct fingerprint, so a group of copies of any size
is one node, and links are never expanded into pairs of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from epispark.llm.common import landed, map_batches, text_slices
from epispark.llm.components import components
from epispark.llm.words import space_words, text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 16


def _joined_words(raw, starts, ends):
    """The words packed with one space after each, and each word's place."""
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - (lengths + 1)
    packed = np.full(int((lengths + 1).sum()), 0x20, dtype=np.uint8)
    rel = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    packed[np.repeat(at, lengths) + rel] = raw[np.repeat(starts, lengths) + rel]
    return packed.tobytes(), at, at + lengths


def simhashes(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of every text: see ``fingerprints``."""
    raw, offsets = text_bytes(column)
    starts, ends, rows = space_words(_LOWER[raw], offsets)
    n_rows = len(offsets) - 1
    words = np.bincount(rows, minlength=n_rows)
    made = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    if not made.sum():
        return np.zeros(n_rows, np.uint64)
    text, at, to = _joined_words(_LOWER[raw], starts, ends)
    # First word of each shingle, and its last word within the same text.
    base = np.repeat(np.cumsum(words) - words, made)
    owner = np.repeat(np.arange(n_rows), made)
    first = base + np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
    last = np.minimum(first + shingle, np.repeat(np.cumsum(words), made)) - 1
    begin, end = at[first], to[last]
    ones = np.zeros((n_rows, 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(first), _BLOCK):
        hashed = np.fromiter((digest(text[a:b], seed) for a, b in zip(begin[i:i + _BLOCK].tolist(), end[i:i + _BLOCK].tolist())),
                             dtype="<u8", count=min(_BLOCK, len(first) - i))
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i:i + _BLOCK]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    majority = (2 * ones > made[:, None]).astype(np.uint64)
    return (majority << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id_col, _fp long)``: one row per input row.

    A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``shingle``
    words (fewer words: all of them), XXH64 with seed 42; a bit is set if over
    half of the shingles' hashes have it.  A null, empty or blank text gives 0.
    """
    def run(batches):
        for batch in text_slices(batches, "_t"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(simhashes(batch.column(1), shingle).view(np.int64))], names=[id_col, "_fp"])

    source = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    schema = T.StructType([source.schema[0], T.StructField("_fp", T.LongType())])
    return map_batches(source, run, schema)


_HALF = 0xFFFFFFFF


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(_HALF))


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints ``fp`` that differ in at
    most ``max_bits`` (0 to 3) bits.

    Multi-index hashing over two 32-bit segments.  If the segment distances
    sum to at most r, the first is at most x or the second at most r - 1 - x;
    so each fingerprint enumerates the Hamming balls of those two radii, one
    per segment, fetches the table entries of each value, and the complete
    distance decides.  Exact: no pair within the distance is missed.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    if max_bits == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    radii = ((max_bits - 1) // 2, max_bits - 1 - (max_bits - 1) // 2)
    flips = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    first, second = _halves(F.col("fp"))

    def ball(value: Column, radius: int) -> Column:
        centre = F.array(value)
        return centre if radius == 0 else F.concat(centre, F.transform(flips, lambda m: value.bitwiseXOR(m)))

    entries = prints.select("fp", F.posexplode(F.array(first, second)).alias("segment", "value"))
    probes = prints.select("fp", F.posexplode(F.array(ball(first, radii[0]), ball(second, radii[1]))).alias("segment", "values"))
    probes = probes.select(F.col("fp").alias("a"), "segment", F.explode("values").alias("value"))
    found = probes.join(entries.withColumnRenamed("fp", "b"), ["segment", "value"])
    return (found.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the least id reachable over links of at most
    ``max_bits`` differing bits (its own included).

    Rows with equal fingerprints are one node, whatever their ids.  Null and
    blank texts have fingerprint zero and are linked like any other.  Null
    ids are grouped but never a component's id, unless all its ids are null.
    Repeated rows give repeated rows; an empty table gives no rows.
    """
    made = landed(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = made.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("_least"))
    groups = components(links(nodes.select("fp"), max_bits), "simhash-links")
    rooted = (nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "_least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    labels = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return made.join(labels, "_fp").select(
        id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
