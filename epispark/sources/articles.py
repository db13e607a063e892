"""Article sources (S6, S7) over landed feed / API records.

Fetching is not part of the library: feeds and API responses are landed
as files (JSON or Parquet) by whatever does the HTTP, and these readers
map them to the common article schema.  JSON files are read with fixed
schemas, one document a line; lines that are no document of that form are set
apart with their text and file, neither lost nor fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P

COMMON = ["article_id", "title", "summary", "link", "published", "source", "source_type"]


FEED_FIELDS = "article_id: long, title: string, link: string, summary: string, published: string, source: string"
API_FIELDS = "article_id: long, title: string, url: string, description: string, publishedAt: string, source: struct<name: string>"
API_COLUMNS = ["article_id", "title", "url", "description", "publishedAt", "source"]
_BAD = "_bad"


def read_documents(spark: SparkSession, path: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines under ``path`` read as ``fields``: the documents, and the
    bad lines (``value``, ``file``).

    Absent fields are null, further ones are ignored, blank lines are nothing.
    A line is bad if it is no JSON object or a field holds another type (a text
    field takes any value, as its JSON text).  The
    two frames are separate scans, so that reading one does not depend on the
    columns asked of the other."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"struct<{fields}, {_BAD}: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    whole = F.ltrim("value").startswith("{")  # an array or a bare value is no document
    made = lines.select("value", F.col("_metadata.file_path").alias("file"), F.when(whole, parsed).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{_BAD}").isNotNull()
    return made.where(~bad).select("r.*").drop(_BAD), made.where(bad).select("value", "file")


_STAMPS = ["yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss XX"]


def published_date(text: Column) -> Column:
    """Day of a publication stamp as feeds and the API write it (UTC); null
    if it has none of these forms, which does not reject an article."""
    text = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, ", "")  # the day's name says nothing more
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in _STAMPS]))


def read_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed feed entries, one a line, in the common schema; and bad lines."""
    entries, bad = read_documents(spark, path, FEED_FIELDS)
    return feed_entries(entries.withColumn("published", published_date(F.col("published")))), bad


def read_api(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed API responses (``articles`` in an array) or single records, one
    a line, in the common schema; and bad lines.  A response without articles,
    as an error is, gives no rows."""
    documents, bad = read_documents(spark, path, f"status: string, articles: array<struct<{API_FIELDS}>>, {API_FIELDS}")
    single = F.array(F.struct(*API_COLUMNS))
    held = F.when(F.col("status").isNull() & F.col("articles").isNull(), single).otherwise(F.col("articles"))
    records = documents.select(F.inline(held))
    return api_records(records.withColumn("publishedAt", published_date(F.col("publishedAt")))), bad


def bad_lines(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Bad lines of each named source, counted; 0 where there are none."""
    counts = [bad.agg(F.count(F.lit(1)).alias("bad_lines")).select(F.lit(name).alias("source_type"), "bad_lines") for name, bad in sources]
    return articles_union(*counts)


def feed_entries(df: DataFrame) -> DataFrame:
    """Feed entries (``title``, ``link``, ``summary``, ``published`` and the
    feed they came from as ``source``) -> common schema; missing texts are
    empty."""
    return df.select("article_id", *[F.coalesce(c, F.lit("")).alias(c) if c in ("link", "summary") else F.col(c) for c in COMMON[1:6]],
                     F.lit("rss").alias("source_type"))


def api_records(df: DataFrame) -> DataFrame:
    """API records (``title``, ``url``, ``description``, ``publishedAt`` and a
    nested ``source.name``) -> common schema; records without a title are
    skipped, a source without a name is ``News API``."""
    return df.where(F.col("title").isNotNull() & (F.col("title") != "")).select(
        "article_id", "title", F.coalesce("description", F.lit("")).alias("summary"), F.coalesce("url", F.lit("")).alias("link"),
        F.col("publishedAt").alias("published"), F.coalesce(F.col("source.name"), F.lit(P.API_SOURCE_DEFAULT)).alias("source"),
        F.lit("news_api").alias("source_type"))


def articles_union(*sources: DataFrame) -> DataFrame:
    """UNION ALL of every source by column name."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def fallback_articles(spark: SparkSession, as_of: str) -> DataFrame:
    """The seven static articles (preset scores), dated ``as_of`` minus 0..6 days."""
    rows = [(-(i + 1), t, s, P.FALLBACK_LINK, d, src, "fallback", score)
            for i, (t, s, d, src, score) in enumerate(P.FALLBACK_ARTICLES)]
    df = spark.createDataFrame(rows, "article_id long, title string, summary string, link string, days int, "
                                     "source string, source_type string, relevance_score int")
    return df.select("article_id", "title", "summary", "link",
                     F.date_sub(F.to_date(F.lit(as_of)), F.col("days")).alias("published"),
                     "source", "source_type", "relevance_score")


def with_fallback(api: DataFrame, spark: SparkSession, as_of: str) -> DataFrame:
    """The API rows, or the static articles when the API yielded nothing.

    The emptiness test is a 1-row count joined in the plan, not a driver
    action.
    """
    n = api.agg(F.count(F.lit(1)).alias("_n"))
    static = fallback_articles(spark, as_of).crossJoin(F.broadcast(n)).where(F.col("_n") == 0).drop("_n")
    return api.withColumn("relevance_score", F.lit(None).cast("int")).unionByName(static)
