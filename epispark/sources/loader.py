"""Windowed loading (S4, S5): scan -> parse dates -> closed window -> clean.

The chain is lazy; on Parquet sources the window predicate reaches the
scan (and partition pruning when the table is partitioned by year/month).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..operators import cleaning as C
from ..operators import filters as X


def load_window(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Parse dates, keep [start, end] on the notification date, then clean."""
    parsed = C.parse_dates(raw)
    windowed = X.require_date(X.filter_date_range(parsed, start, end))
    return C.clean_symptoms(C.clean_age(C.clean_codes(windowed)))


def load_with_fallback(raw: DataFrame, report_date: str, today: str, days: int = 365,
                       historical_start: str = P.PLAUSIBLE_MIN_DATE) -> DataFrame:
    """Last ``days`` days ending at the report date (clamped to today);
    when that window is empty, everything from ``historical_start`` to today.

    One small aggregate decides the mode; its values enter the filter as
    scalar subqueries, so the bounds reach the scan.
    """
    end = F.least(F.to_date(F.lit(report_date)), F.to_date(F.lit(today)))
    start = F.date_sub(end, days)
    parsed = C.parse_dates(raw)
    d = F.col(P.DATE_COL)
    recent = F.col("_recent") > 0
    probe = parsed.agg(F.count_if(d.between(start, end)).alias("_recent")).select(
        F.when(recent, F.lit("recent")).otherwise(F.lit("historical")).alias("mode"),
        F.when(recent, start).otherwise(F.to_date(F.lit(historical_start))).alias("lo"),
        F.when(recent, end).otherwise(F.to_date(F.lit(today))).alias("hi"))
    picked = (parsed.where(d.isNotNull() & (d >= probe.select("lo").scalar()) & (d <= probe.select("hi").scalar()))
              .withColumn("mode", probe.select("mode").scalar()))
    return C.clean_symptoms(C.clean_age(C.clean_codes(picked)))
