"""Mergeable state of the quality checks (Q1-Q11), kept by batch of the load.

Every check of one row at a time is a count, so the counts of the batches add
up; outliers need the counts of a column's values, duplicates the counts of row
hashes, which add up as well.  The state of a batch is made from that batch's
rows alone.  A report over all of them reads three narrow tables, and a new
month rescans its own year (or whatever the batch is), not the history.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numbers import to_number
from .profile import row_hashes
from .quality import wide_parts

TABLES = ("counters", "values", "rows")


@dataclass(frozen=True)
class QualityState:
    """``counters``: a row per batch with every count of the wide checks;
    ``values``: ``v, c`` per batch of the outlier column; ``rows``: row and key
    hashes with ``n`` per batch."""

    counters: DataFrame
    values: DataFrame
    rows: DataFrame


def year_batch(date_col: str = P.DATE_COL) -> Column:
    """The batch of a raw row: the first four characters of its date."""
    return F.coalesce(F.substring(F.col(date_col).cast("string"), 1, 4), F.lit("none"))


def quality_state(df: DataFrame, batch: Column | None = None, field: str = P.AGE_COL) -> QualityState:
    """The state of ``df`` (raw cases), by ``batch`` (a year unless given)."""
    rows = df.withColumn("_batch", year_batch() if batch is None else batch)
    aggs, _ = wide_parts(df)
    values = (rows.select("_batch", to_number(field).alias("v")).where(F.col("v").isNotNull()).groupBy("_batch", "v").agg(F.count(F.lit(1)).alias("c"))
              if field in df.columns else rows.limit(0).select("_batch", F.lit(None).cast("double").alias("v"), F.lit(0).cast("bigint").alias("c")))
    hashed = rows.select("_batch", *row_hashes(df))
    return QualityState(rows.groupBy("_batch").agg(*[c.alias(n) for n, c in aggs.items()]), values,
                        hashed.groupBy(*hashed.columns).agg(F.count(F.lit(1)).alias("n")))


def save_state(state: QualityState, path: str) -> None:
    """Write the batches that ``state`` holds under ``path``, replacing those
    that are there; other batches stay as they are.  The tables are written as
    their counts leave them: the row hashes, as many as rows, are shuffled
    once."""
    for name in TABLES:
        (getattr(state, name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch").parquet(f"{path}/{name}"))


def refresh_state(df: DataFrame, path: str, batches: Iterable[str], batch: Column | None = None) -> None:
    """Make the state of the given batches again from their rows in ``df``.
    A batch must have rows left (a state has no other way to lose one)."""
    by = year_batch() if batch is None else batch
    save_state(quality_state(df.where(by.isin(sorted(set(batches)))), by), path)


def load_state(spark: SparkSession, path: str) -> QualityState:
    return QualityState(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])
