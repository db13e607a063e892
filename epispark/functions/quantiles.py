"""Exact quantiles of a column with any number of distinct values.

``percentile`` keeps a map of all values in one task.  Here the distinct
values with their counts are range partitioned and written with their running
counts per partition; the partitions' totals, one row each, give every
partition its offset, and a quantile is looked up by its place in the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def exact_quantiles(counted: DataFrame, probs: Sequence[float], partitions: int | None = None) -> DataFrame:
    """``n`` (sum of the counts) and ``q`` (an array of the quantiles of
    ``probs``, linear between neighbours) of distinct values ``v`` with counts
    ``c``, in one row; with no value, ``n`` and ``q`` are null.

    The values are written to the shared folder, so that the two passes over
    them see the same partitions; no task holds more than its range."""
    spark = counted.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = counted.select("v", "c").repartitionByRange(parts, "v").withColumn("_pid", F.spark_partition_id())
    path = scratch_path(spark, "quantiles")
    ranged.write.parquet(path)
    written = spark.read.schema(ranged.schema).parquet(path)
    sizes = written.groupBy("_pid").agg(F.sum("c").alias("_size"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_size").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    total = sizes.agg(F.sum("_size").alias("n"))
    # The places that the quantiles lie between, numbered from 0.
    place = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in probs])
    ranks = total.select("n", F.posexplode(place).alias("i", "at")).select(
        "n", "i", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    within = F.sum("c").over(Window.partitionBy("_pid").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    placed = (written.withColumn("_first", F.coalesce(within, F.lit(0))).join(F.broadcast(offsets), "_pid")  # a row per partition
              .select("v", (F.col("_first") + F.col("_offset")).alias("lo"), (F.col("_first") + F.col("_offset") + F.col("c")).alias("hi")))
    found = placed.join(F.broadcast(ranks), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))  # two rows per quantile at most
    low, high = F.min("v"), F.max("v")
    value = F.when(low == high, low).otherwise((F.ceil(F.first("at")) - F.first("at")) * low + (F.first("at") - F.floor(F.first("at"))) * high)
    each = found.groupBy("i").agg(F.first("n").alias("n"), value.alias("q"))
    return each.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "q"))).alias("s")).select(
        "n", F.when(F.col("n").isNotNull(), F.transform("s", lambda x: x["q"])).alias("q"))
