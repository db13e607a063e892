"""Descriptive profile of the case table.

Scalar statistics are gathered in one wide ``agg`` and unpivoted; value
counts of several columns share one scan by exploding ``(section, key)``
pairs before a single partially-aggregated ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numbers import round_double, round_ratio
from .cleaning import _present


def value_counts(df: DataFrame, col: str, k: int | None = None, dropna: bool = False) -> DataFrame:
    """A3: counts per value (null is its own group unless ``dropna``); top-k
    with a total order (count desc, value asc)."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    out = src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if k is not None:
        out = out.orderBy(F.desc("count"), F.asc_nulls_last(col)).limit(k)
    return out


def completeness(df: DataFrame, cols: Sequence[str] = P.ESSENTIAL_COLUMNS) -> DataFrame:
    """A4: non-null count and percent (2 dp) per present column, one scan."""
    present = _present(df, cols)
    stats = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in present])
    stacked = stats.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null_count")) for c in present])).alias("s"))
    return stacked.select("s.column", "s.non_null_count",
                          round_ratio(F.col("s.non_null_count"), F.col("_n")).alias("completeness_percent"))


def _age_aggs(age: Column) -> list[Column]:
    return [
        F.count(age).alias("n"),
        round_ratio(F.sum(age), F.count(age), 0, 1).alias("mean"),
        round_double(F.median(age), 1).alias("median"),
        F.min(age).cast("bigint").alias("min"),
        F.max(age).cast("bigint").alias("max"),
    ]


def age_summary(df: DataFrame, col: str = P.AGE_COL) -> DataFrame:
    """A5: mean and exact median (1 dp), min, max of non-null ages.

    The exact median keeps a value->count map per group; for ages that
    map has at most 121 keys, so it is bounded at any row count.
    """
    return df.agg(*_age_aggs(F.col(col)))


def age_ranges(df: DataFrame, col: str = P.AGE_COL) -> DataFrame:
    """Counts of 0-17, 18-59 and 60+."""
    a = F.col(col)
    return df.agg(F.count_if(a < 18).alias("age_0_17"),
                  F.count_if((a >= 18) & (a < 60)).alias("age_18_59"),
                  F.count_if(a >= 60).alias("age_60_plus"))


def date_span(df: DataFrame, col: str = P.DATE_COL) -> DataFrame:
    """First, last and number of days between."""
    d = F.col(col)
    return df.agg(F.min(d).alias("start"), F.max(d).alias("end")).select(
        "start", "end", F.datediff("end", "start").alias("total_days"))


def _exploded_counts(df: DataFrame, sections: Sequence[tuple[str, str]]) -> DataFrame:
    """Value counts of several columns in one scan and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).cast("string").alias("item"))
                      for s, c in sections])
    return (df.select(F.explode(pairs).alias("p")).groupBy("p.section", "p.item")
            .agg(F.count(F.lit(1)).alias("count")))


def severity_indicators(df: DataFrame) -> DataFrame:
    """ICU count and outcome distribution, long form."""
    icu = df.agg(F.count_if(F.col(P.ICU_COL) == "1").alias("count")).select(
        F.lit("uti_cases").alias("indicator"), F.lit(None).cast("string").alias("code"), "count")
    evo = value_counts(df, P.OUTCOME_COL, dropna=True).select(
        F.lit("evolution").alias("indicator"), F.col(P.OUTCOME_COL).alias("code"), "count")
    return icu.unionByName(evo)


def data_summary(df: DataFrame, top_k: int = 5) -> DataFrame:
    """Total, span, completeness, age statistics, top states, outcome
    and vaccination distributions as one long table
    ``(section, item, value, text_value)``.

    Two scans of the input: one wide aggregate for every scalar and one
    exploded group-by for the three distributions.
    """
    present = _present(df, P.ESSENTIAL_COLUMNS)
    a, d = F.col(P.AGE_COL), F.col(P.DATE_COL)
    stats = df.agg(F.count(F.lit(1)).alias("_n"), F.min(d).alias("_start"), F.max(d).alias("_end"),
                   *[F.count(F.col(c)).alias("c_" + c) for c in present],
                   F.count(a).alias("age_n"), F.sum(a).alias("age_sum"), F.median(a).alias("age_median"),
                   F.min(a).alias("age_min"), F.max(a).alias("age_max"))

    def row(section, item, value=None, text=None):
        return F.struct(F.lit(section).alias("section"), F.lit(item).cast("string").alias("item"),
                        (value if value is not None else F.lit(None)).cast("double").alias("value"),
                        (text if text is not None else F.lit(None)).cast("string").alias("text_value"))

    rows = [
        row("total_records", None, F.col("_n")),
        row("date_range", "start", None, F.col("_start").cast("string")),
        row("date_range", "end", None, F.col("_end").cast("string")),
        row("date_range", "total_days", F.datediff("_end", "_start")),
    ]
    rows += [row("completeness", c, round_ratio(F.col("c_" + c), F.col("_n"))) for c in present]
    age_ok = F.col("age_n") > 0
    rows += [
        row("age", "mean", F.when(age_ok, round_ratio(F.col("age_sum"), F.col("age_n"), 0, 1))),
        row("age", "median", F.when(age_ok, round_double(F.col("age_median"), 1))),
        row("age", "min", F.floor("age_min")),
        row("age", "max", F.floor("age_max")),
    ]
    scalars = stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    counts = _exploded_counts(df, [("top_states", P.STATE_COL), ("evolution", P.OUTCOME_COL),
                                   ("vaccination_status", "STATUS_VACINAL_COVID")]).where(F.col("item").isNotNull())
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("count"), "item"))
    dist = counts.withColumn("_p", place).where((F.col("section") != "top_states") | (F.col("_p") <= top_k))
    dist = dist.select("section", "item", F.col("count").cast("double").alias("value"),
                       F.lit(None).cast("string").alias("text_value"))
    return scalars.unionByName(dist)


def dedupe_cases(df: DataFrame, keys: Sequence[str] = P.DEDUP_KEYS, order: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row per key (nulls compare equal).

    Applied only when the first three keys exist.  "First" is the
    smallest ``(order columns, remaining columns)`` tuple, a total order,
    computed with ``min(struct)`` so each map task pre-combines its rows
    before the shuffle (a hot key sends one row per task, not all rows).
    """
    if not all(k in df.columns for k in keys[:3]):
        return df
    keys = [k for k in keys if k in df.columns]
    order = list(order or [P.ID_COL])
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col("_first." + c).alias(c) for c in order + rest]).select(*df.columns)


def row_hashes(df: DataFrame, keys: Sequence[str] = P.DUPLICATE_KEYS) -> list[Column]:
    """Two independent 64-bit hashes of the whole row and of its keys."""
    def hashed(columns: Sequence[str], names: tuple[str, str]) -> list[Column]:
        # A hash passes over nulls, so they are marked.
        marked = [c for n in columns for c in (F.col(n), F.col(n).isNull())] or [F.lit(0)]
        return [F.xxhash64(F.lit(seed), *marked).alias(name) for seed, name in enumerate(names)]

    return [*hashed(df.columns, ("_r0", "_r1")), *hashed(_present(df, keys), ("_k0", "_k1"))]


def duplicate_counts(df: DataFrame, keys: Sequence[str] = P.DUPLICATE_KEYS, counted: DataFrame | None = None) -> DataFrame:
    """Full-row and key duplicates (surplus rows beyond the first).

    ``counted`` are row hashes with their counts ``n`` that were made from the
    rows of ``df`` before; then only its columns are looked at."""
    present = _present(df, keys)
    hashes = ["_k0", "_k1", "_r0", "_r1"]
    # One scan; only hashes are shuffled.  Distinct full rows feed the key groups.
    rows = (df.select(*row_hashes(df, keys)).groupBy(*hashes).agg(F.count(F.lit(1)).alias("n")) if counted is None
            else counted.groupBy(*hashes).agg(F.sum("n").alias("n")))
    groups = rows.groupBy("_k0", "_k1").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("full"))
    j = groups.agg(F.sum("n").alias("total"), F.sum("full").alias("full_groups"), F.count(F.lit(1)).alias("key_groups"))
    total = F.coalesce(F.col("total"), F.lit(0)).cast("bigint")
    full, key = F.coalesce("full_groups", F.lit(0)), (F.col("key_groups") if present else total)
    return j.select(
        total.alias("total_records"),
        (total - full).cast("bigint").alias("complete_duplicates"),
        (total - key).cast("bigint").alias("key_field_duplicates"),
        F.lit(",".join(present)).alias("key_fields_used"),
        key.cast("bigint").alias("unique_records"),
    )
