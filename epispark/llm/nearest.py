"""Approximate nearest neighbours by multi-index hashing (operator 5).

Vectors get binary codes by a learned rotation (PCA, then iterative
quantisation on a bounded sample).  Codes are cut into substrings, each with
an index from value to rows.  By the pigeonhole principle a code within radius
r of a query differs in at most r // m bits in one of its m substrings, so
probing those small balls retrieves every code within r; the complete distance
is then checked and the survivors are ranked by their original floats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from epispark.llm.common import landed, map_batches

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.exists(vector, lambda x: x != 0) & ~bad


class Codes:
    """A learned code: mean, projection, and the search radius."""

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 40, neighbours: int = 10,
                 probes: int = 400, share: float = 0.98, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.bits = min(bits, sample.shape[1])
        _, axes = np.linalg.eigh(centred.T @ centred)
        main = axes[:, ::-1][:, :self.bits]
        low = centred @ main
        turn = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ vt).T
        self.turn = main @ turn
        self.radius = self._radius(sample, rng, neighbours, probes, share)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes, one byte per substring."""
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)

    def _radius(self, sample, rng, neighbours, probes, share) -> int:
        """Distance within which ``share`` of the sample's own true neighbours
        lie.  Over all rows neighbours are nearer than in a sample of them, so
        the radius errs on the wide side."""
        codes = self.of(sample)
        reach = []
        for i in rng.choice(len(sample), size=min(probes, len(sample)), replace=False):
            far = ((sample - sample[i]) ** 2).sum(axis=1)
            far[i] = np.inf
            near = np.argsort(far, kind="stable")[:neighbours]
            reach.append(_ONES[codes[near[near != i]] ^ codes[i]].sum(axis=1))
        reach = np.concatenate(reach) if reach else np.zeros(0)
        return int(np.ceil(np.quantile(reach, share))) if len(reach) else self.bits


def fit(vectors: DataFrame, sample: int = 8000, **limits) -> Codes | None:
    """Codes learned from at most ``sample`` rows: the least hashes of the id."""
    rows = vectors.select("_v").orderBy(F.xxhash64("_id", "_v"), "_id").limit(sample).collect()
    return Codes(np.array([r[0] for r in rows], dtype=np.float64), **limits) if rows else None


class _Index:
    """Substring tables of one batch of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = np.argsort(codes, axis=0, kind="stable")
        values = np.arange(257)
        self.starts = [np.searchsorted(codes[self.rows[:, j], j], values) for j in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``, each once."""
        m = len(code)
        found = np.zeros(len(self.codes), dtype=bool)
        for j in range(m):
            # r = a*m + b: b + 1 substrings need radius a, the others a - 1.
            reach = radius // m - (j > radius % m)
            ball = np.flatnonzero(_ONES[np.arange(256) ^ code[j]] <= reach) if reach >= 0 else []
            for value in ball:
                found[self.rows[self.starts[j][value]:self.starts[j][value + 1], j]] = True
        rows = np.flatnonzero(found)
        return rows[_ONES[self.codes[rows] ^ code].sum(axis=1) <= radius]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(index: DataFrame, queries: list, model: Codes, radius: int, k: int) -> DataFrame:
    """The ``k`` best of every batch of the index for each query of a block."""
    wanted = np.array([q["_v"] for q in queries], dtype=np.float64)
    shared = index.sparkSession.sparkContext.broadcast(  # bounded by the block size
        ([q["_row"] for q in queries], np.array([q["_id"] for q in queries], dtype=np.int64), wanted, model.of(wanted), radius))

    def run(batches):
        rows, own, vectors, codes, r = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, floats = batch.column(0).to_numpy(), _matrix(batch.column(2))
            held = _Index(np.array([np.frombuffer(c, np.uint8) for c in batch.column(1).to_pylist()]))
            out: list[list] = [[], [], []]
            for i in range(len(rows)):
                near = held.within(codes[i], r)
                near = near[ids[near] != own[i]]
                if not len(near):
                    continue
                far = np.sqrt(((floats[near] - vectors[i]) ** 2).sum(axis=1))
                if len(near) > k:  # all ties of the k-th stay until the ids decide
                    few = far <= np.partition(far, k - 1)[k - 1]
                    near, far = near[few], far[few]
                best = np.lexsort((ids[near], far))[:k]
                out[0] += [rows[i]] * len(best)
                out[1] += ids[near[best]].tolist()
                out[2] += far[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                                             names=["_row", "_near", "score"])

    return map_batches(index, run, "_row long, _near long, score double")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
            block: int = 20_000, sample: int = 8000) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows
    found for every row that ``is_query`` (an expression over ``id_col``).

    Euclidean distance in double precision on the original vectors, ties to
    the smaller id; rows with the query's id are not candidates.  A query with
    fewer than ``k`` codes within the radius is searched again over all codes,
    so it gets ``k`` rows, or all candidates if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do those whose length differs from the most common one of the
    rows, nor rows with a null id.  A repeated query row is answered once per
    row.  Every row is indexed.  Queries go over the index in blocks of
    ``block`` rows, the only rows that the driver holds.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), is_query.alias("_q"))
    length = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if length is None:
        return empty
    rows = rows.where(F.size("_v") == length["n"])
    model = fit(rows, sample, neighbours=k)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.of(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), batch.column(2)],
                                                 names=["_id", "_code", "_v", "_q"])

    schema = T.StructType([rows.schema[0], T.StructField("_code", T.BinaryType()), rows.schema[1], rows.schema[2]])
    index = landed(map_batches(rows, encode, schema), "codes")
    asked = index.where("_q").select("_id", "_v")
    parts = max(1, -(-asked.count() // block))
    asked = landed(asked.withColumn("_row", F.monotonically_increasing_id())
                   .withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(parts))), "queries")
    candidates = index.count()
    found = None
    top = W.partitionBy("_row").orderBy("score", "_near")
    for b in range(parts):
        queries = asked.where(F.col("_block") == b).collect()  # one block, bounded by its expected size
        if not queries:
            continue
        near = landed(_ranked(_search(index, queries, model, model.radius, k), top, k), "near")
        full = {r["_row"] for r in near.groupBy("_row").count().where(F.col("count") >= min(k, candidates - 1)).collect()}
        if rest := [q for q in queries if q["_row"] not in full]:
            again = _ranked(_search(index, rest, model, 8 * len(model.of(model.mean[None])[0]), k), top, k)
            gone = spark.createDataFrame([(q["_row"],) for q in rest], "_row long")
            near = near.join(gone, "_row", "left_anti").unionByName(again)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return empty
    return found.join(asked.select("_row", F.col("_id").alias("query_id")), "_row").select(
        "query_id", "rank", F.col("_near").alias("vec_id"), "score")


def _ranked(found: DataFrame, top, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
