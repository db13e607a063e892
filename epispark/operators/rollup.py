"""Daily rollup of the case table: one row per notification day with the
counters of every rate, kept as a table beside the cases.

The rates, the series and the reference date read it instead of the cases: a
few thousand rows whatever the case table holds.  It is partitioned by year,
and a load that touches some years refreshes those only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from .cleaning import _present
from .metrics import daily_summary


def daily_rollup(cases: DataFrame) -> DataFrame:
    """``day``, the counters of ``daily_summary`` and ``ANO``; rows without a
    date are not counted.  Without any dose column there is no ``vaccinated``,
    which is how a rate sees that vaccination is not recorded."""
    daily = daily_summary(cases).withColumn("ANO", F.year("day"))
    return daily if _present(cases, P.RATE_DOSE_COLUMNS) else daily.drop("vaccinated")


def save_rollup(rollup: DataFrame, path: str) -> None:
    """One file per year.  Years that ``rollup`` does not hold stay as they
    are, so this also replaces single years."""
    (rollup.repartition("ANO").sortWithinPartitions("day").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("ANO").parquet(path))


def refresh_rollup(cases: DataFrame, path: str, years: Iterable[int]) -> None:
    """Count the given years again, reading only their cases, and replace
    them in the rollup at ``path``.  A year without a dated case is kept as a
    row of zeros at its first day, so that its old counts do not remain."""
    years = sorted(set(years))
    own = cases.where(F.col("ANO").isin(years)) if "ANO" in cases.columns else cases.where(F.year(P.DATE_COL).isin(years))
    fresh = daily_rollup(own)
    zero = cases.sparkSession.createDataFrame([(y,) for y in years], "ANO int").select(
        "ANO", F.make_date("ANO", F.lit(1), F.lit(1)).alias("day"),
        *[F.lit(0).cast("bigint").alias(c) for c in fresh.columns if c not in ("day", "ANO")])
    gone = zero.join(fresh.select("ANO").distinct(), "ANO", "left_anti")
    save_rollup(fresh.unionByName(gone), path)


def load_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The rollup at ``path``, without the zero rows of emptied years."""
    return spark.read.parquet(path).where(F.col("cases") > 0)


def is_rollup(df: DataFrame) -> bool:
    return {"day", "cases"} <= set(df.columns)
