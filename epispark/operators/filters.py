"""Row filters on the case table.

All are plain ``where`` predicates on typed columns, so on a Parquet or
partitioned source Catalyst pushes them to the scan (and prunes
``ANO``/``MES`` partitions when the table was written that way).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P


def _ym(date_text: str) -> int:
    y, m = date_text[:4], date_text[5:7]
    return int(y) * 100 + int(m)


def partition_window(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Add the year/month partition predicate implied by a date window.

    On a table partitioned by ``ANO``/``MES`` (see ``sources.sinks``) this
    prunes whole partitions before any file is opened; the exact date
    predicate still decides row by row.  Other tables are returned as is.
    """
    if "ANO" not in df.columns or "MES" not in df.columns or (start is None and end is None):
        return df
    ym = F.col("ANO") * 100 + F.col("MES")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ym >= _ym(start))
    if end is not None:
        cond = cond & (ym <= _ym(end))
    return df.where(cond)


def filter_date_range(df: DataFrame, start: str | None = None, end: str | None = None,
                      col: str = P.DATE_COL) -> DataFrame:
    """Closed range; either end optional."""
    if col == P.DATE_COL:
        df = partition_window(df, start, end)
    d = F.col(col)
    if start is not None and end is not None:
        return df.where(d.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if start is not None:
        return df.where(d >= F.to_date(F.lit(start)))
    if end is not None:
        return df.where(d <= F.to_date(F.lit(end)))
    return df


def require_date(df: DataFrame, col: str = P.DATE_COL) -> DataFrame:
    """Drop rows without a notification date."""
    return df.dropna(subset=[col]) if col in df.columns else df


def filter_temporal_order(df: DataFrame, earlier: str = P.DATE_COL, later: str = P.OUTCOME_DATE_COL) -> DataFrame:
    """Keep when the outcome date is missing or not before notification."""
    if earlier not in df.columns or later not in df.columns:
        return df
    return df.where(F.col(later).isNull() | (F.col(later) >= F.col(earlier)))


def drop_all_null(df: DataFrame, cols: Sequence[str] = (P.DATE_COL, P.STATE_COL)) -> DataFrame:
    """Drop rows where every listed (present) column is null."""
    present = [c for c in cols if c in df.columns]
    return df.dropna(how="all", subset=present) if present else df


def filter_plausible_date(df: DataFrame, as_of: str, min_date: str = P.PLAUSIBLE_MIN_DATE,
                          col: str = P.DATE_COL) -> DataFrame:
    """Keep null dates and dates in [min_date, as_of]."""
    d, lo, hi = F.col(col), F.to_date(F.lit(min_date)), F.to_date(F.lit(as_of))
    if col == P.DATE_COL and {"ANO", "MES"} <= set(df.columns):
        ym = F.col("ANO") * 100 + F.col("MES")
        df = df.where(ym.isNull() | ym.between(F.lit(int(min_date[:4]) * 100 + int(min_date[5:7])), F.lit(int(as_of[:4]) * 100 + int(as_of[5:7]))))
    return df.where(d.isNull() | d.between(lo, hi))


def filter_plausible_age(df: DataFrame, col: str = P.AGE_COL, lo: float = P.AGE_MIN, hi: float = P.AGE_MAX) -> DataFrame:
    """Keep null ages and ages in [lo, hi]."""
    a = F.col(col)
    return df.where(a.isNull() | a.between(lo, hi))
