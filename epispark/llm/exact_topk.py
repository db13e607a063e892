"""Exact top-k search by inner product (operator 12).

Vectors are packed into tiles: matrices of bounded rows and bytes.  A block of
query tiles, bounded too, is broadcast and meets every tile of the shards;
each meeting is one matrix product and a partial selection per query row.  A
task keeps one running top list per query; those lists are merged in a tree,
``fan`` shard partitions at a time, each level a grouped limit in Spark.

Exact search costs queries times rows; what moves is the blocks (to every
executor) and the top lists.  The shards are read in place, once per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from epispark.llm.common import landed, map_batches
from epispark.llm.int_vectors import exact, int_rows, largest, matrix

TILE_ROWS, TILE_BYTES = 2048, 1 << 20
_TILE = "tile long, block long, dim int, ids binary, held binary"
_TOP = "tile long, at long, query_id long, vec_id long, score long, part long"


def tiles(rows: DataFrame, per_block: int = 1) -> DataFrame:
    """``_id, _v`` packed within their partitions into tiles of one vector
    length, rows by ascending id; ``block`` numbers ``per_block`` tiles of one
    partition.  Neither depends on when or where a task runs."""
    def run(batches):
        task, made, waiting = TaskContext.get().partitionId(), 0, {}

        def packed(dim):
            nonlocal made
            ids, held = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            order = np.argsort(ids, kind="stable")
            row = [(task << 32) + made, (task << 32) + made // per_block, dim, ids[order].tobytes(), held[order].tobytes()]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                              names=["tile", "block", "dim", "ids", "held"])

        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                own = pa.array(sizes == dim)
                ids, held = batch.column(0).filter(own).to_numpy(), matrix(batch.column(1).filter(own), dim)
                most = max(1, min(TILE_ROWS, TILE_BYTES // max(4 * dim, 1)))
                while len(ids):
                    room = most - sum(len(x) for x, _ in waiting.get(dim, []))
                    waiting.setdefault(dim, []).append((ids[:room], held[:room]))
                    if len(ids) >= room:
                        yield packed(dim)
                    ids, held = ids[room:], held[room:]
        for dim in list(waiting):
            yield packed(dim)

    return map_batches(rows, run, _TILE)


def tile_top(queries: np.ndarray, query_ids: np.ndarray, held: np.ndarray, ids: np.ndarray, k: int):
    """Query row, id and score of each query's ``k`` best rows of one tile
    (ids ascending), all ties of the k-th included; never the query's own id."""
    dim = queries.shape[1]
    kind = exact(dim * largest(queries) * largest(held))
    scores = queries.astype(kind) @ held.astype(kind).T
    if kind is object:  # Python integers; a score that no long holds is the nearest long
        scores = np.array([[max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in row] for row in scores], dtype=np.int64).reshape(len(queries), len(held))
    own = np.zeros(scores.shape, dtype=bool)
    first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for i in np.flatnonzero(last > first):
        own[i, first[i]:last[i]] = True
    least = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    ranked = np.where(own, least, scores)
    if k < len(ids):
        kth = np.partition(ranked, len(ids) - k, axis=1)[:, len(ids) - k]
        row, col = np.nonzero((ranked >= kth[:, None]) & ~own)
    else:
        row, col = np.nonzero(~own)
    return row, ids[col], scores[row, col].astype(np.int64)


def merged(a: tuple, b: tuple, k: int) -> tuple:
    """The ``k`` best of two sets of (row, id, score), per row: highest score
    first, ties to the smaller id."""
    row, ids, score = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((ids, ~score, row))  # ~ reverses the order of integers
    row, ids, score = row[order], ids[order], score[order]
    start = np.searchsorted(row, row, "left")
    few = np.arange(len(row)) - start < k
    return row[few], ids[few], score[few]


def _lists(shards: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """Top lists of the block's queries over each partition of the shards."""
    meetings = shards.select("dim", "ids", "held").join(F.broadcast(block.select(  # bounded by tiles in a block
        "dim", "tile", F.col("ids").alias("query_ids"), F.col("held").alias("queries"))), "dim")

    def run(batches):
        best: dict[int, tuple] = {}
        asked: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, ids, held, tile, query_ids, queries in zip(*(c.to_pylist() for c in batch.columns)):
                ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
                found = tile_top(np.frombuffer(queries, np.int32).reshape(len(query_ids), dim), query_ids,
                                 np.frombuffer(held, np.int32).reshape(len(ids), dim), ids, k)
                nothing = tuple(x[:0] for x in found)
                best[tile], asked[tile] = merged(best.get(tile, nothing), found, k), query_ids
        part = TaskContext.get().partitionId()
        for tile, (row, ids, score) in best.items():
            columns = [np.full(len(row), tile), row, asked[tile][row], ids, score, np.full(len(row), part)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["tile", "at", "query_id", "vec_id", "score", "part"])

    return map_batches(meetings, run, _TOP)


def _tree(lists: DataFrame, k: int, fan: int) -> DataFrame:
    """The lists of ``fan`` neighbouring parts merged again and again, until
    one list per query is left."""
    parts = (lists.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // fan)
        top = W.partitionBy("tile", "at", "part").orderBy(F.desc("score"), "vec_id")
        lists = (lists.withColumn("part", F.expr(f"part div {fan}")).withColumn("rank", F.row_number().over(top))
                 .where(F.col("rank") <= k))
        if parts <= 1:
            return lists
        lists = lists.drop("rank")


def exact_topk(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256,
               block_tiles: int = 16, fan: int = 16) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for every row
    that ``is_query`` the ``k`` rows of highest inner product, ties to the
    smaller id; all candidates, if there are fewer.

    Components count as floor(scale * x).  Candidates of a query are all rows
    of its vector's length but those with its own id.  A score beyond 64 bits
    is the nearest 64-bit integer.  Null vectors, vectors with null or
    non-finite components or with integers beyond 32 bits, and rows with a null
    id take no part.  Repeated candidate rows are each listed, a repeated query
    row is answered once per row.  An empty table gives no rows.

    The driver sees one block of query tiles at a time (``block_tiles`` of at
    most 1 MB each), never a query's candidates.
    """
    spark = vectors.sparkSession
    rows = landed(int_rows(vectors.where(F.col(id_col).isNotNull()), vector_col, scale,
                           F.col(id_col).cast("long").alias("_id"), is_query.alias("_q")), "int-vectors")
    shards = landed(tiles(rows.select("_id", "_v")), "shard-tiles")
    asked = rows.where("_q").select("_id", "_v")
    size = asked.agg(F.coalesce(F.sum(F.size("_v") * 4 + 8), F.lit(0))).first()[0]
    queries = landed(tiles(asked.repartition(max(1, -(-size // (block_tiles * TILE_BYTES)))), block_tiles), "query-tiles")
    found = []
    for block in sorted(r["block"] for r in queries.select("block").distinct().collect()):
        lists = landed(_lists(shards, queries.where(F.col("block") == block), k), "top-lists")
        found.append(landed(_tree(lists, k, fan).select("query_id", "rank", "vec_id", "score"), "top"))
    out = found[0] if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for more in found[1:]:
        out = out.unionByName(more)
    return out
