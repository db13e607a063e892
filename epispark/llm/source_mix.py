"""Mixing sources to target weights (operator 2), in DataFrame functions only.

Targets fill to a cap in closed form, Sainte-Lague apportionment turns them
into whole numbers of equal-token blocks per source and then per shard, and a
seeded permutation of each shard's blocks picks which blocks are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from epispark.llm.common import landed

WORD = r"[^\x20\x09-\x0D]+"
# The largest primes below 2**31, multipliers of block orders.
PRIMES = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Per source: ``_n`` (place by code point, null last), ``n_docs``,
    ``source_size`` and ``target``.

    All sizes are shared by the repeating weights; a target stops at ``most``
    times its source's size and the excess goes to the others by weight.  The
    fixed point of that sharing is min(cap, level * weight): with sources in
    order of cap over weight, the level is the largest of (what earlier caps
    leave) / (weights not yet capped).  One row per source is all it sorts.
    """
    per = (sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
           .withColumn("_n", F.row_number().over(W.orderBy(F.col("_source").isNull(), "_source")))
           .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1))
           .withColumn("_cap", F.col("source_size") * float(most)))
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    per = per.withColumn("_level", F.max((total - before) / ahead).over(W.partitionBy()))
    per = per.withColumn("_level", F.max("_level").over(W.partitionBy()))
    return per.select("_source", "_n", "n_docs", "source_size",
                      F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def apportion(cells: DataFrame, votes: str, seats: str, by: list[str], order: str) -> DataFrame:
    """``cells`` with ``quota``: ``seats`` (one value per group ``by``) dealt
    to the group's cells by the highest quotients votes / (2k - 1).

    Seats that every cell is sure of come from a divisor known to deal too
    few; only quotients between that divisor and one known to deal enough are
    listed (about twice the number of cells) and ranked.  Ties go by ``order``.
    """
    group = W.partitionBy(*by) if by else W.partitionBy()
    v, half = F.col(votes).cast("double"), F.count("*").over(group) / 2
    total = F.sum(F.col(votes).cast("double")).over(group)
    low, high = F.greatest(F.col(seats) - half, F.lit(0.0)), F.col(seats) + half
    dealt = (cells
             .withColumn("_sure", F.when(total > 0, F.floor(v * low / total + 0.5)).otherwise(0).cast("long"))
             .withColumn("_top", F.when((total > 0) & (v > 0) & (F.col(seats) > 0), F.floor(v * high / total + 0.5) + 1).otherwise(0).cast("long"))
             .withColumn("_left", F.col(seats) - F.sum(F.when(F.col(seats) > 0, F.col("_sure")).otherwise(0)).over(group))
             .withColumn("_k", F.explode_outer(F.when(F.col("_top") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_top")))))
             .withColumn("_q", v / (2 * F.col("_k") - 1)))
    ranked = dealt.withColumn("_r", F.row_number().over(
        (W.partitionBy(*by) if by else W.partitionBy()).orderBy(F.col("_q").desc_nulls_last(), order)))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_r") <= F.col("_left")), 1).otherwise(0))
    return ranked.groupBy(*cells.columns).agg((F.first("_sure") + won).alias("quota"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block: int = 16,
                shard_docs: int = 5000, seed: int = 42) -> DataFrame:
    """One row per input row: ``id_col``, ``size`` (words), ``source_size``,
    ``target`` (its source's) and ``taken`` (words the mix takes, repeats
    counted).

    A source's documents are dealt to shards of about ``shard_docs`` by a hash
    of the id, and strung together in a seeded order; the string is cut into
    blocks of ``block`` words.  A shard with quota q and n blocks takes every
    block q // n times and q % n of them once more, chosen by a seeded
    permutation of the block numbers.  No block, hence no document, is taken
    more than ``most`` times.  The result depends on the rows alone.

    Null and blank texts have size 0 and take 0; a null source is a source of
    its own, last in order; a null id is hashed as such.  Repeated rows are
    rows of their own.  An empty table gives no rows.  Rows shuffle as ids and
    sizes, never texts; a hot source is many shards.
    """
    sizes = landed(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                               word_count(F.col(text_col)).alias("size")), "sizes")
    per = targets(sizes, weights, most).withColumn("_shards", F.ceil(F.col("n_docs") / shard_docs).cast("int"))
    total = F.sum("source_size").over(W.partitionBy())
    seats = apportion(per.withColumn("_seats", F.round(total / block).cast("long")), "target", "_seats", [], "_n")
    sources = landed(seats, "sources")

    spot = F.xxhash64(F.col("_id").cast("string"), F.lit(seed))
    placed = (sizes.join(sources.select(F.col("_source").alias("_s"), "_n", "_shards", "source_size", "target", F.col("quota").alias("_seats")),
                         F.col("_source").eqNullSafe(F.col("_s")))
              .withColumn("_shard", F.pmod(spot, F.col("_shards"))))
    cells = (placed.groupBy("_n", "_shard").agg(F.sum("size").alias("_cell"), F.first("_seats").alias("_seats"))
             .withColumn("_blocks", F.ceil(F.col("_cell") / block).cast("long")))
    quotas = (apportion(cells, "_cell", "_seats", ["_n"], "_shard")
              .select("_n", "_shard", "_blocks", F.least(F.col("quota"), most * F.col("_blocks")).alias("_quota")))

    line = W.partitionBy("_n", "_shard").orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit(seed + 1)), "_id", "size")
    strung = placed.withColumn("_from", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    full = strung.join(quotas, ["_n", "_shard"])
    draw = F.xxhash64("_n", "_shard", F.lit(seed + 2))
    full = (full.withColumn("_extra", F.when(F.col("_blocks") > 0, F.col("_quota") % F.col("_blocks")).otherwise(0))
            .withColumn("_a", F.element_at(F.array(*[F.lit(p) for p in PRIMES]).cast("array<bigint>"), (F.pmod(draw, F.lit(len(PRIMES))) + 1).cast("int")))
            .withColumn("_b", F.when(F.col("_blocks") > 0, F.pmod(draw, F.col("_blocks"))).otherwise(0))
            .withColumn("_to", F.col("_from") + F.col("size")))

    def more(taken: Column, k: Column) -> Column:
        picked = F.pmod(F.col("_a") * k + F.col("_b"), F.col("_blocks")) < F.col("_extra")
        overlap = F.least((k + 1) * block, F.col("_to")) - F.greatest(k * block, F.col("_from"))
        return taken + F.when(picked, overlap).otherwise(F.lit(0).cast("long"))

    own = F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))
    once_more = F.when((F.col("size") > 0) & (F.col("_extra") > 0), F.aggregate(own, F.lit(0).cast("long"), more)).otherwise(0)
    whole = F.when(F.col("_blocks") > 0, F.floor(F.col("_quota") / F.col("_blocks"))).otherwise(0).cast("long")
    return full.select(F.col("_id").alias(id_col), "size", "source_size", "target",
                       (F.col("size") * whole + once_more).cast("long").alias("taken"), F.col("_source").alias(source_col))
