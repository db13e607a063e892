"""Global ranking without a single-partition window.

``global_rank`` numbers rows 1..N in a total order.  Rows are range
partitioned on the order, sorted inside each partition, and written with their
partition and position to the shared folder; partition sizes and ranks are
then read from that one table.  (Range bounds come from a sample: positions
and sizes of two separate shuffles need not agree, those of one written table
do.)  The offset table has one row per partition, so no task ever sees more
than its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    path = scratch_path(spark, "ranked")
    ranged.write.parquet(path)
    written = spark.read.schema(ranged.schema).parquet(path)
    sizes = written.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_pid", F.sum("_size").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_offset"))
    return (written.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_pos") + 1).cast("bigint"))
            .drop("_pid", "_pos", "_offset"))
