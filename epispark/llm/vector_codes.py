"""Vector code compression by member-resident Lloyd rounds (operator 13).

Vectors are cut into equal parts, and every part position has a codebook.  The
members, one row per vector and position, lie partitioned by (position, entry,
salt): a part of an entry's members, its owner, sits in one partition, and the
salt splits entries that hold very many.  An owner sums its members where they
lie, so an update gathers one row per entry from a task.  Reassigning is a map
over the members in place; only the parts whose entry changes go through the
next shuffle, to their new owner.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from epispark.llm.common import landed, map_batches
from epispark.llm.int_vectors import exact, int_rows, largest, matrix

LABEL_SALTS = 16


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, ties to the lower index, and
    the squared distance: exact integers at any size of component."""
    bound = 4 * parts.shape[1] * max(largest(parts), largest(entries)) ** 2
    kind = object if exact(bound) is object else np.float64
    x, c = parts.astype(kind), entries.astype(kind)
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    entry = np.argmin(far, axis=1) if len(far) else np.zeros(0, np.int64)
    return entry.astype(np.int64), far[np.arange(len(far)), entry]


def _update(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at the floor of its members' mean; unused ones stay."""
    names = [c for c in members.columns if c.startswith("_c")]
    sums = members.groupBy("position", "entry").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in names])
    books = books.copy()
    for r in sums.collect():  # one row per position and entry, whatever the input
        books[r["position"], r["entry"]] = [r[c] // r["n"] for c in names]
    return books


def _owned(members: DataFrame) -> DataFrame:
    return members.repartition("position", "entry", "salt").sortWithinPartitions("position", "entry")


def _members(rows: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """Every part with the nearest entry of its codebook."""
    parts, _, dim = books.shape
    names = [f"_c{i}" for i in range(dim)]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        made = TaskContext.get().partitionId() * 7919
        for batch in batches:
            held = matrix(batch.column(0), parts * dim).reshape(-1, parts, dim)
            salt = (np.arange(batch.num_rows) + made) % salts
            made += batch.num_rows
            for p in range(parts):
                entry, _ = nearest_entries(held[:, p], shared.value[p])
                columns = [np.full(batch.num_rows, p, np.int32), entry.astype(np.int32), salt.astype(np.int32), *held[:, p].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["position", "entry", "salt", *names])

    return map_batches(rows.select("_v"), run, ", ".join(f"{n} int" for n in ["position", "entry", "salt", *names]))


def _judged(members: DataFrame, books: np.ndarray) -> DataFrame:
    """The members where they lie, with the entry that is now the nearest."""
    names = [c for c in members.columns if c.startswith("_c")]
    shared = members.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            position = batch.column(0).to_numpy()
            held = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names], axis=1)
            now = np.zeros(batch.num_rows, np.int32)
            for p in np.unique(position):
                own = position == p
                now[own] = nearest_entries(held[own], shared.value[p])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now)], names=[*batch.schema.names, "now"])

    return map_batches(members, run, T.StructType([*members.schema.fields, T.StructField("now", T.IntegerType())]))


def learn(rows: DataFrame, books: np.ndarray, rounds: int, owner_rows: int) -> np.ndarray:
    """The codebooks after ``rounds`` of assigning and updating."""
    salts = max(1, -(-rows.count() // owner_rows))
    members = None
    for _ in range(rounds):
        if members is None:
            members = landed(_owned(_members(rows, books, salts)), "members")
        else:
            judged = landed(_judged(members, books), "members")
            moved = judged.where("entry <> now").withColumn("entry", F.col("now"))
            members = judged.where("entry = now").unionByName(landed(_owned(moved), "moved")).drop("now")
        books = _update(members, books)
    return books


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Codes and errors of the vectors under the final codebooks."""
    parts, _, dim = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            held = matrix(batch.column(2), parts * dim).reshape(-1, parts, dim)
            code, error = np.zeros((batch.num_rows, parts), np.int64), np.zeros(batch.num_rows, object)
            for p in range(parts):
                code[:, p], far = nearest_entries(held[:, p], shared.value[p])
                error += far
            width = max(2, len(f"{max(len(shared.value[0]) - 1, 0):x}"))
            text = ["".join(f"{e:0{width}x}" for e in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()),
                                              pa.array([min(int(e), (1 << 63) - 1) for e in error], pa.int64())], names=["_id", "_label", "code", "error"])

    return map_batches(rows.select("_id", "_label", "_v"), run, T.StructType(
        [rows.schema["_id"], rows.schema["_label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16,
                 entries: int = 64, rounds: int = 2, scale: int = 256, owner_rows: int = 20_000) -> DataFrame:
    """One row per kept vector: ``id_col``, ``code`` (the entry of each part,
    two hex digits, more if ``entries`` is above 256), ``error`` (squared
    distances to those entries), ``label_error`` (``error`` summed over the rows
    of the same label, nulls together) and ``codebooks`` (the final entries'
    components by part, entry and position, comma-joined).

    Components count as floor(scale * x).  A codebook starts as that part of
    the ``entries`` smallest ids (null ids last, ties by vector); with fewer
    kept vectors there are fewer entries.  A part goes to its nearest entry by
    squared Euclidean distance, ties to the lower index; entries move to the
    floor of their parts' mean, unused ones stay.

    Vectors that are null, hold null or non-finite components, or integers
    beyond 32 bits, take no part; neither do those whose length is not the
    commonest (the shorter, if tied) of the lengths that ``parts`` divides.  A
    null id or label is kept, repeated rows each count and are returned.  An
    empty table gives no rows.

    The driver holds the codebooks: ``entries`` vectors, whatever the input.
    """
    rows = landed(int_rows(vectors, vector_col, scale, F.col(id_col).alias("_id"), F.col(label_col).alias("_label")), "int-vectors")
    length = (rows.groupBy(F.size("_v").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
              .orderBy(F.desc("count"), "n").first())
    rows = rows.where(F.size("_v") == (length["n"] if length else -1))
    seeds = [r["_v"] for r in rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()]
    dim = len(seeds[0]) // parts if seeds else 1
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, dim).transpose(1, 0, 2)
    if seeds:
        books = learn(rows, books, rounds, owner_rows)
    coded = landed(_coded(rows, books), "codes").withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(LABEL_SALTS)))
    # A label may hold a third of all rows: its total goes to several keys.
    totals = (coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
              .withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1)))))
    text = ",".join(str(int(x)) for x in books.ravel())
    return coded.join(totals, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_s") == F.col("_t"))).select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(text).alias("codebooks"))
