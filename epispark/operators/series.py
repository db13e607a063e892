"""Case time series.

Counting is one partially-aggregated ``groupBy(day)``; everything after
it (calendar fill, moving average, summaries) runs on at most one row
per calendar day of the window, so the single-partition window of W1
works on a bounded input (31 rows by default) however large the case
table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numbers import round_ratio


def _d(x: str):
    return F.to_date(F.lit(x))


def daily_counts(cases: DataFrame, as_of: str, days: int = 30, col: str = P.DATE_COL) -> DataFrame:
    """A1: cases per day in [as_of - days, as_of], from the case table or its
    daily rollup."""
    import datetime as _dt

    if {"day", "cases"} <= set(cases.columns):
        return cases.where(F.col("day").between(F.date_sub(_d(as_of), days), _d(as_of))).select(F.col("day").alias("date"), "cases")

    from .filters import partition_window

    start = (_dt.date.fromisoformat(as_of) - _dt.timedelta(days=days)).isoformat()
    d = F.col(col)
    return (partition_window(cases, start, as_of).where(d.between(F.date_sub(_d(as_of), days), _d(as_of)))
            .groupBy(d.alias("date")).agg(F.count(F.lit(1)).alias("cases")))


def calendar(spark: SparkSession, start, end) -> DataFrame:
    """One row per day of [start, end] (both Columns or date strings)."""
    s = _d(start) if isinstance(start, str) else start
    e = _d(end) if isinstance(end, str) else end
    return spark.range(1).select(F.explode(F.sequence(s, e, F.expr("INTERVAL 1 DAY"))).alias("date"))


def daily_calendar_fill(cases: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Every day of the window with its count, zero when absent.

    Both sides hold at most ``days + 1`` rows; the counted side is
    broadcast (its size is bounded by the calendar, not by the data).
    """
    spark = cases.sparkSession
    cal = calendar(spark, F.date_sub(_d(as_of), days), _d(as_of))
    daily = daily_counts(cases, as_of, days)
    return (cal.join(F.broadcast(daily), "date", "left")
            .select("date", F.coalesce(F.col("cases"), F.lit(0)).cast("bigint").alias("cases")))


def moving_average(series: DataFrame, rows: int = 7, value: str = "cases", order: str = "date",
                   name: str = "moving_average_7d") -> DataFrame:
    """Trailing mean over ``rows`` rows, null until the frame is full."""
    w = Window.orderBy(order).rowsBetween(-(rows - 1), 0)
    return series.withColumn(
        name, F.when(F.count(F.lit(1)).over(w) == rows, F.sum(value).over(w) / float(rows)))


def monthly_counts(cases: DataFrame, as_of: str, days: int = 365, col: str = P.DATE_COL) -> DataFrame:
    """A2: cases per month in [as_of - days, as_of]; when that window is
    empty, every case from ``max(date) - days`` on (no upper bound).

    From the daily rollup, the days of both windows (one entry each) meet in
    one row that chooses.  From the case table, whether the window holds a
    case, and the newest date, enter as scalar subqueries; every scan is cut
    to the months it needs.
    """
    from .metrics import months_between, newest_date

    if {"day", "cases"} <= set(cases.columns):
        return _by_month(_chosen_days(cases, as_of, days))
    d, lo, hi = F.col(col), F.date_sub(_d(as_of), days), _d(as_of)
    recent = months_between(cases, lo, hi).where(d.between(lo, hi)).agg((F.count(F.lit(1)) > 0).alias("v")).scalar()
    newest = newest_date(cases, col).scalar()
    start, end = F.when(recent, lo).otherwise(F.date_sub(newest, days)), F.when(recent, hi).otherwise(newest)
    picked = (months_between(cases, start, end).where(d.between(start, end))
              .groupBy(d.alias("day")).agg(F.count(F.lit(1)).alias("n")))
    return _by_month(picked)


def _chosen_days(daily: DataFrame, as_of: str, days: int) -> DataFrame:
    lo, hi = F.date_sub(_d(as_of), days), _d(as_of)
    row = daily.agg(F.max("day").alias("newest"), F.collect_list(F.struct("day", F.col("cases").alias("n"))).alias("all"))
    recent = row.select("newest", "all", F.filter("all", lambda x: x["day"].between(lo, hi)).alias("some"))
    chosen = F.when(F.size("some") > 0, F.col("some")).otherwise(F.filter("all", lambda x: x["day"] >= F.date_sub("newest", days)))
    return recent.select(F.inline(chosen))


def _by_month(picked: DataFrame) -> DataFrame:
    return (picked.groupBy(F.year("day").alias("year"), F.month("day").alias("month"))
            .agg(F.sum("n").cast("bigint").alias("cases"))
            .withColumn("month_start", F.make_date("year", "month", F.lit(1)))
            .orderBy("month_start"))


def series_summary(series: DataFrame, key: str = "date", value: str = "cases") -> DataFrame:
    """Total, mean (1 dp), peak and the earliest key reaching the peak."""
    v = F.col(value)
    return series.agg(
        F.sum(v).cast("bigint").alias("total_cases"),
        round_ratio(F.sum(v), F.count(F.lit(1)), 0, 1).alias("avg_cases"),
        F.max(v).cast("bigint").alias("peak_cases"),
        F.max_by(F.col(key), F.struct(v, -F.unix_date(F.col(key)))).alias("peak_" + key),
        F.count(F.lit(1)).alias("points"),
    )
