"""Fixture inputs derived from the driver tables.

``raw_cases`` (one untyped case row per lineitem) and ``articles`` (one
news article per document) are defined by SQL text that runs unchanged
in Spark and in the DuckDB oracle.  Spark receives the base tables as
DataFrame arguments of ``spark.sql`` so no session-wide view is created.

``raw_cases`` is one shuffle of the narrow columns of lineitem and of
orders (both grow with the data); the orders meet their customers first, by
sort-merge or broadcast as AQE decides from the runtime size, and nation
(25 rows) is always broadcast by the planner.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_CASES_SQL = """
SELECT
  cast(l.l_orderkey * 10 + l.l_linenumber AS string) AS NU_NOTIFIC,
  CASE WHEN l.l_orderkey % 397 = 0 THEN NULL WHEN l.l_orderkey % 401 = 0 THEN '2001-13-45' ELSE cast(cast(o.o_orderdate AS date) AS string) END AS DT_NOTIFIC,
  CASE WHEN l.l_orderkey % 397 = 0 AND l.l_linenumber % 2 = 0 OR l.l_partkey % 307 = 0 THEN NULL ELSE n.n_name END AS SG_UF_NOT,
  cast(100000 + o.o_custkey AS string) AS CO_MUN_NOT,
  CASE WHEN l.l_partkey % 50 = 0 THEN 'I' WHEN l.l_partkey % 50 = 1 THEN 'X' WHEN l.l_partkey % 2 = 0 THEN 'F' ELSE 'M' END AS CS_SEXO,
  CASE WHEN l.l_partkey % 20 = 0 THEN NULL WHEN l.l_partkey % 97 = 0 THEN 'abc' WHEN l.l_partkey % 101 = 0 THEN '12d' ELSE cast((l.l_suppkey * 7 + l.l_linenumber * 13 + l.l_orderkey) % 131 - 5 AS string) END AS NU_IDADE_N,
  CASE WHEN (l.l_orderkey + l.l_linenumber) % 41 = 0 THEN '5' WHEN (l.l_orderkey + l.l_linenumber) % 37 = 0 THEN '9' WHEN (l.l_orderkey + l.l_linenumber) % 8 = 0 THEN '1.0' WHEN (l.l_orderkey + l.l_linenumber) % 4 = 0 THEN '1' ELSE '2' END AS UTI,
  CASE WHEN l.l_partkey % 3 = 0 THEN '1' ELSE '2' END AS HOSPITAL,
  CASE WHEN l.l_returnflag = 'R' THEN '1' WHEN l.l_returnflag = 'A' AND l.l_quantity < 15 THEN '2.0' WHEN l.l_returnflag = 'A' THEN '1.0' WHEN l.l_quantity < 5 THEN '3' WHEN l.l_quantity > 48 THEN '8' WHEN l.l_quantity > 40 THEN NULL ELSE '9' END AS EVOLUCAO,
  cast(CASE WHEN l.l_linenumber = 7 THEN cast(cast(o.o_orderdate AS date) - INTERVAL '3' DAY AS date) WHEN l.l_linenumber = 6 THEN NULL ELSE cast(cast(o.o_orderdate AS date) + cast(l.l_partkey % 60 AS int) AS date) END AS string) AS DT_EVOLUCA,
  CASE WHEN l.l_partkey % 211 = 0 THEN '32/13/2024' WHEN l.l_discount > 0.025 THEN concat(substr(d1, 9, 2), '/', substr(d1, 6, 2), '/', substr(d1, 1, 4)) END AS DOSE_1_COV,
  CASE WHEN l.l_discount > 0.045 THEN concat(substr(d2, 9, 2), '/', substr(d2, 6, 2), '/', substr(d2, 1, 4)) END AS DOSE_2_COV,
  CASE WHEN l.l_discount > 0.065 THEN concat(substr(d3, 9, 2), '/', substr(d3, 6, 2), '/', substr(d3, 1, 4)) END AS DOSE_REF,
  CASE WHEN l.l_discount > 0.085 THEN concat(substr(d3, 9, 2), '/', substr(d3, 6, 2), '/', substr(d3, 1, 4)) END AS DOSE_2REF,
  CASE WHEN l.l_discount > 0.095 THEN concat(substr(d3, 9, 2), '/', substr(d3, 6, 2), '/', substr(d3, 1, 4)) END AS DOSE_ADIC,
  CASE WHEN l.l_partkey % 2 = 0 THEN '1' ELSE '2' END AS FEBRE,
  CASE WHEN l.l_partkey % 3 = 0 THEN '1' ELSE '2' END AS TOSSE,
  CASE WHEN l.l_partkey % 5 = 0 THEN '1' ELSE '9' END AS DISPNEIA,
  CASE WHEN l.l_partkey % 7 = 0 THEN '1' END AS DESC_RESP,
  CASE WHEN l.l_suppkey % 3 = 0 THEN '1' ELSE '2' END AS DIARREIA,
  CASE WHEN l.l_suppkey % 5 = 0 THEN '1' ELSE '2' END AS VOMITO
FROM {lineitem} l
JOIN (SELECT *, cast(cast(cast(o_orderdate AS date) - INTERVAL '400' DAY AS date) AS string) AS d1,
             cast(cast(cast(o_orderdate AS date) - INTERVAL '300' DAY AS date) AS string) AS d2,
             cast(cast(cast(o_orderdate AS date) - INTERVAL '100' DAY AS date) AS string) AS d3 FROM {orders}) o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# Further columns of the source: symptom, admission and birth dates (some
# absent, some out of order) and the vaccination code (some invalid).
DETAILED_CASES_SQL = """
SELECT r.*,
  CASE WHEN n % 11 = 0 THEN NULL WHEN n % 17 = 0 THEN cast(cast(d + INTERVAL '2' DAY AS date) AS string) ELSE cast(cast(d - INTERVAL '5' DAY AS date) AS string) END AS DT_SIN_PRI,
  CASE WHEN n % 7 = 0 THEN NULL WHEN n % 19 = 0 THEN cast(cast(d + INTERVAL '1' DAY AS date) AS string) WHEN n % 23 = 0 THEN '31/12/99' ELSE cast(d AS string) END AS DT_INTERNA,
  CASE WHEN n % 5 = 0 THEN NULL WHEN n % 3 = 0 THEN cast(cast(d - INTERVAL '20000' DAY AS date) AS string) WHEN n % 3 = 1 THEN cast(cast(d - INTERVAL '364' DAY AS date) AS string) ELSE cast(cast(d - INTERVAL '7300' DAY AS date) AS string) END AS DT_NASC,
  CASE WHEN n % 5 = 0 THEN '1.0' WHEN n % 5 = 1 THEN '2' WHEN n % 5 = 2 THEN '9' WHEN n % 5 = 3 THEN '7' END AS VACINA_COV
FROM (SELECT *, cast(NU_NOTIFIC AS bigint) AS n, try_cast(DT_NOTIFIC AS date) AS d FROM {raw_cases}) r
"""

ARTICLES_SQL = """
SELECT doc_id AS article_id,
  CASE WHEN doc_id % 53 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
  concat(text,
         CASE WHEN doc_id % 10 = 0 THEN ' CPF 123.456.789-00' ELSE '' END,
         CASE WHEN doc_id % 10 = 1 THEN ' (11) 99999-9999' ELSE '' END,
         CASE WHEN doc_id % 10 = 2 THEN ' paciente@example.com' ELSE '' END,
         CASE WHEN doc_id % 10 = 3 THEN ' Fake News' ELSE '' END,
         CASE WHEN doc_id % 7 = 0 THEN ' aumento de casos' ELSE '' END,
         CASE WHEN doc_id % 7 = 1 THEN ' UTI e hospital' ELSE '' END,
         CASE WHEN doc_id % 7 = 2 THEN ' campanha de vacinação' ELSE '' END,
         CASE WHEN doc_id % 11 = 0 THEN ' milagre' ELSE '' END) AS summary,
  concat('https://', source, '.example.com/', cast(doc_id AS string)) AS link,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE cast(DATE '2001-06-01' - cast(doc_id % 150 AS int) AS date) END AS published,
  CASE WHEN source = 'src1' THEN 'g1.globo.com' WHEN source = 'src2' THEN 'www.folha.uol.com.br' WHEN source = 'src3' THEN 'portal.fiocruz.br' ELSE source END AS source,
  CASE WHEN doc_id % 3 = 0 THEN 'rss' WHEN doc_id % 3 = 1 THEN 'news_api' ELSE 'fallback' END AS source_type
FROM {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_cases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped, CSV-like case table computed from the base tables.

    The columns of ``RAW_CASES_SQL`` over its joins in another order: orders
    with their customers and nations, and these with lineitem last, always by
    a shuffle of both (``merge``).  So only narrow rows are shuffled, the wide
    rows of strings are made where they are written, and the shuffle deals
    them evenly whatever files the tables are in."""
    def some(name, *columns):
        return table(spark, sf_dir, name).select(*columns)

    orders = (some("orders", "o_orderkey", "o_custkey", "o_orderdate")
              .join(some("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
              .join(some("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
              .select("o_orderkey", "o_custkey", "o_orderdate", "n_name"))
    lines = some("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_discount")
    joined = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    before = [F.date_sub(F.to_date("o_orderdate"), days).cast("string").alias(name) for name, days in (("d1", 400), ("d2", 300), ("d3", 100))]
    rows = joined.select(F.struct(*lines.columns).alias("l"), F.struct("o_custkey", "o_orderdate").alias("o"), F.struct("n_name").alias("n"), *before)
    return spark.sql(RAW_CASES_SQL.split("FROM {lineitem}")[0] + "FROM {rows}", rows=rows)


def articles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News articles with an ``article_id`` order column, from ``documents``."""
    return spark.sql(ARTICLES_SQL, documents=table(spark, sf_dir, "documents"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News articles, landed once: title (the first line), whole text, and
    the derived columns."""
    return landed(spark, sf_dir, "articles", lambda: articles_query(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# ----------------------------------------------------------------------------
# Landed tables
#
# The case table is landed once per session as Parquet under the shared
# checkpoint folder (``spark.checkpoint.dir``): the raw strings, and the
# cleaned + derived table partitioned by ANO/MES.  Every case query then
# starts from a plain Parquet scan (small generated code, partition and
# row-group pruning on the date) instead of re-running the four-table
# join, and the written table cuts the lineage, so a lost executor
# recomputes from Parquet rather than from the join.
# ----------------------------------------------------------------------------
_LOCK = threading.RLock()
_LANDED: dict[tuple[str, str, str], str] = {}


def landed_path(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
                write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Write ``build()`` once per session under a fresh path in the shared
    checkpoint folder and return that path."""
    from ..session import scratch_path

    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    with _LOCK:
        path = _LANDED.get(key)
        if path is None:
            path = scratch_path(spark, name)
            if write is None:
                # An input of one unsplittable row group is read by one task;
                # rebalancing lets every later stage read even files.
                build().hint("rebalance").write.mode("overwrite").parquet(path)
            else:
                write(build(), path)
            _LANDED[key] = path
    return path


def landed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
           write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    return spark.read.parquet(landed_path(spark, sf_dir, name, build, write))


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped, CSV-like case table (every column a string), landed once, as
    the join deals it: its rows are not shuffled again."""
    return landed(spark, sf_dir, "raw_cases", lambda: raw_cases_query(spark, sf_dir), lambda df, path: df.write.mode("overwrite").parquet(path))


def detailed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_cases`` with the columns of ``DETAILED_CASES_SQL``."""
    return spark.sql(DETAILED_CASES_SQL, raw_cases=raw_cases(spark, sf_dir)).drop("n", "d")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, cleaned and derived case table, landed once, partitioned by ANO/MES."""
    from ..operators.cleaning import calendar_exprs, clean, derive
    from .sinks import save_processed

    month = [c for c in calendar_exprs() if c in ("ANO", "MES")]

    def cleaned():
        return clean(raw_cases(spark, sf_dir)).withColumns({c: calendar_exprs()[c] for c in month})

    def derived(df):  # the month stays the column that the rows are sorted by
        out = derive(df.withColumnsRenamed({c: "_" + c for c in month}))
        return out.select(*[F.col("_" + c).alias(c) if c in month else c for c in out.columns if c[1:] not in month])

    return landed(spark, sf_dir, "cases", cleaned, lambda df, path: save_processed(df, path, derive=derived))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rollup of the case table, landed once beside it."""
    from ..operators.rollup import daily_rollup, load_rollup, save_rollup

    return load_rollup(spark, landed_path(spark, sf_dir, "rollup", lambda: daily_rollup(cases(spark, sf_dir)), save_rollup))


def quality_state(spark: SparkSession, sf_dir: str):
    """Quality state of the raw cases by year, landed once."""
    from ..operators import quality_state as QS

    return QS.load_state(spark, landed_path(spark, sf_dir, "quality_state", lambda: QS.quality_state(raw_cases(spark, sf_dir)), QS.save_state))
