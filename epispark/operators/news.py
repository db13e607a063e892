"""News article analytics.

Keyword tests are ``contains`` on the lower-cased ``title summary`` text,
compiled by whole-stage codegen; the text is lower-cased once per row.
Per-keyword presence over a corpus is a ``max`` aggregate (one row out,
partial aggregation per task) instead of a concatenated corpus string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as TX
from ..functions.numbers import round_ratio
from ..functions.ranking import global_rank
from ..functions.rows import keep_if

EDGE_SPACE = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"

ARTICLE_COLS = ["article_id", "title", "summary", "link", "published", "source", "source_type"]


def _text() -> Column:
    return TX.article_text("title", "summary")


TEXT = "_t"


def _with_text(df: DataFrame) -> DataFrame:
    """Lower-cased text as its own column: keyword expressions then read one
    column instead of repeating the text expression (which would bloat the
    generated code past the JVM method limit)."""
    return df.withColumn(TEXT, _text())


def _t() -> Column:
    return F.col(TEXT)


# ---------------------------------------------------------------- X7 / X8 / N6 / N7
def article_recency(df: DataFrame, as_of: str, days: int = P.NEWS_DATE_RANGE_DAYS) -> DataFrame:
    """Reject only dated articles older than the cutoff."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days)
    return df.where(F.col("published").isNull() | (F.col("published") >= cutoff))


def term_match_expr(terms: Sequence[str] = P.SEARCH_TERMS) -> Column:
    """Any search term in the ``_t`` text column."""
    return TX.any_of(_t(), sorted({t.lower() for t in terms}))


def article_term_filter(df: DataFrame, terms: Sequence[str] = P.SEARCH_TERMS) -> DataFrame:
    """Keep articles mentioning any search term."""
    return keep_if(_with_text(df), term_match_expr(terms)).drop(TEXT)


def matching_terms(df: DataFrame, terms: Sequence[str] = P.SEARCH_TERMS, limit: int = P.MATCHING_TERMS_SHOWN) -> DataFrame:
    """The first ``limit`` matching terms (in list order, as written)."""
    text = _t()
    arr = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t.lower())), F.lit(t)) for t in terms]))
    hits = keep_if(_with_text(df), term_match_expr(terms)).select("article_id", arr.alias("_m"))
    return hits.select("article_id", F.array_join(F.slice("_m", 1, limit), ", ").alias("matching_terms"),
                       F.size("_m").alias("terms_matched"))


def search_funnel(df: DataFrame, as_of: str, days: int = P.NEWS_DATE_RANGE_DAYS,
                  terms: Sequence[str] = P.SEARCH_TERMS) -> DataFrame:
    """Total, rejected for no term, rejected as old (term test first), accepted."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days)
    match = term_match_expr(terms)
    old = F.col("published").isNotNull() & (F.col("published") < cutoff)
    s = _with_text(df).agg(F.count(F.lit(1)).alias("total_entries"),
               F.count_if(~match).alias("rejected_no_terms"),
               F.count_if(match & old).alias("rejected_old_date"),
               F.count_if(match & ~old).alias("accepted"))
    return s.select("*", round_ratio(F.col("accepted"), F.col("total_entries"), 2, 1).alias("approval_rate"))


# ---------------------------------------------------------------- W4 / N1 / O2 / O3
def article_dedupe(df: DataFrame, order: str = "article_id") -> DataFrame:
    """First article per lower-cased, whitespace-stripped title; empty or
    null titles dropped.

    ``min(struct(order, ...))`` keeps the first row per key with map-side
    pre-combination, so a title repeated across a third of the corpus is
    reduced per task before the shuffle.
    """
    # strip every ASCII whitespace character at both ends (tabs, CR, ...), not only spaces
    key = F.lower(F.regexp_replace(F.col("title"), EDGE_SPACE, ""))
    cols = [order] + [c for c in df.columns if c != order]
    return (df.where(key.isNotNull() & (key != "")).groupBy(key.alias("_key"))
            .agg(F.min(F.struct(*cols)).alias("_a")).select(*[F.col("_a." + c).alias(c) for c in df.columns]))


def relevance_expr(keywords: Sequence[str] = P.RELEVANCE_KEYWORDS) -> Column:
    """Number of keyword entries present in the ``_t`` text column."""
    return TX.count_of(_t(), keywords)


def article_relevance(df: DataFrame, keywords: Sequence[str] = P.RELEVANCE_KEYWORDS, min_score: int = 1) -> DataFrame:
    """relevance = number of list entries found (multiset); keep >= min_score.

    The text is lower-cased once into ``_t``; the score is a sum of
    ``contains`` tests on that column, kept by ``keep_if`` so the
    predicate stays above the projection that computed it.
    """
    scored = _with_text(df).withColumn("relevance_score", relevance_expr(keywords))
    return keep_if(scored, F.col("relevance_score") >= min_score).drop(TEXT)


def rank_order() -> list[Column]:
    return [F.desc("relevance_score"), F.asc("article_id")]


def article_rank(scored: DataFrame) -> DataFrame:
    """O2: stable sort by relevance (ties keep article order), as a rank column."""
    return global_rank(scored, rank_order(), "rank")


def article_topk(scored: DataFrame, k: int = P.MAX_ARTICLES) -> DataFrame:
    """O3: top-k by relevance (TakeOrderedAndProject: a bounded heap per task)."""
    return scored.orderBy(*rank_order()).limit(k)


# ---------------------------------------------------------------- N3 / N4 / O4 / A10
def themes_expr(themes=P.ARTICLE_THEMES, text: Column | None = None) -> Column:
    text = _text() if text is None else text
    return F.array_compact(F.array(*[F.when(TX.any_of(text, words), F.lit(label)) for label, words in themes]))


def article_themes(df: DataFrame) -> DataFrame:
    """Theme labels of each article (list order)."""
    t = _with_text(df).select("article_id", themes_expr(text=_t()).alias("_th"))
    return t.select("article_id", F.array_join("_th", "|").alias("themes"), F.size("_th").alias("theme_count"))


def theme_breakdown(df: DataFrame) -> DataFrame:
    """A10: articles per identified theme."""
    return _with_text(df).select(F.explode(themes_expr(text=_t())).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("articles"))


def theme_counts_wide(df: DataFrame, themes=P.WIDE_THEMES) -> DataFrame:
    """Articles per theme with the wide word lists, one scan."""
    text = _t()
    stats = _with_text(df).agg(*[F.count_if(TX.any_of(text, words)).alias(name) for name, words in themes])
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("theme"), F.col(name).alias("articles")) for name, _ in themes])).alias("t")).select("t.*")


def theme_members(df: DataFrame, themes=P.WIDE_THEMES) -> DataFrame:
    """Every article of every wide theme, one scan."""
    text = _t()
    return _with_text(df).select("article_id", "title", "link", F.explode(F.array_compact(F.array(*[
        F.when(TX.any_of(text, words), F.lit(name)) for name, words in themes]))).alias("theme"))


def theme_top(df: DataFrame, n: int = P.THEME_TOP_N, themes=P.WIDE_THEMES) -> DataFrame:
    """The first ``n`` articles (input order) of every wide theme.

    ``row_number() <= n`` per theme is planned with a WindowGroupLimit, so
    each task keeps only n rows per theme before the shuffle.
    """
    tagged = theme_members(df, themes)
    w = Window.partitionBy("theme").orderBy("article_id")
    return tagged.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


# ---------------------------------------------------------------- A11 / A13 / N5
def simplified_source_expr(col: str = "source") -> Column:
    s = F.coalesce(F.col(col), F.lit("Desconhecido"))
    expr = None
    for needle, insensitive, label in P.SOURCE_NAMES:
        cond = F.contains(F.lower(s), F.lit(needle)) if insensitive else F.contains(s, F.lit(needle))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(s)


def source_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy(simplified_source_expr().alias("source")).agg(F.count(F.lit(1)).alias("articles"))


def article_origin_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_type").agg(F.count(F.lit(1)).alias("articles"))


# ---------------------------------------------------------------- N2 context score
def context_score(df: DataFrame, keywords=P.CONTEXT_KEYWORDS) -> DataFrame:
    """Per category min(0.3 * distinct keywords present anywhere, 2.5),
    plus min(0.15 * articles, 2.0), capped at 10 (0 without articles).

    Presence of a keyword over all articles is ``max`` of a per-article flag
    (one aggregate row), computed in integer hundredths.
    """
    text = _t()
    flags = []
    for cat, words in keywords.items():
        for i, w in enumerate(words):
            flags.append(F.max(F.contains(text, F.lit(w)).cast("int")).alias(f"{cat}__{i}"))
    s = _with_text(df).agg(F.count(F.lit(1)).alias("articles"), *flags)
    cols, parts = [], []
    for cat, words in keywords.items():
        m = sum((F.coalesce(F.col(f"{cat}__{i}"), F.lit(0)) for i in range(len(words))), F.lit(0))
        cols.append(m.alias(f"{cat}_mentions"))
        parts.append(F.least(m * int(P.CONTEXT_PER_KEYWORD * 100), F.lit(int(P.CONTEXT_CATEGORY_CAP * 100))))
    bonus = F.least(F.col("articles") * int(P.CONTEXT_PER_ARTICLE * 100), F.lit(int(P.CONTEXT_ARTICLE_CAP * 100)))
    total = F.least(sum(parts, F.lit(0)) + bonus, F.lit(int(P.CONTEXT_CAP * 100)))
    score = F.when(F.col("articles") == 0, F.lit(0.0)).otherwise(total / 100.0)
    return s.select("articles", *cols, score.alias("context_score"))


# ---------------------------------------------------------------- N8 / N9 / N10
def truncate_summary(df: DataFrame, max_chars: int = P.SUMMARY_MAX_CHARS) -> DataFrame:
    return df.select("article_id", TX.truncate("summary", max_chars).alias("summary_short"))


def heuristic_counts(df: DataFrame, themes=P.HEURISTIC_THEMES) -> DataFrame:
    text = _t()
    return _with_text(df).agg(F.count(F.lit(1)).alias("articles"),
                  *[F.count_if(TX.any_of(text, words)).alias(name) for name, words in themes])


def heuristic_analysis(df: DataFrame, growth: DataFrame) -> DataFrame:
    """Theme counts and the fallback narrative; growth is a 1-row frame
    with column ``growth_rate``."""
    c = heuristic_counts(df).crossJoin(F.broadcast(growth))
    lines = F.concat(
        F.lit("Análise de Contexto de Notícias ("), F.col("articles").cast("string"), F.lit(" artigos analisados):\n"),
        F.lit("\n\nTemas identificados nas notícias:\n- Aumento de casos: "), F.col("increase").cast("string"),
        F.lit(" artigos\n- Mortalidade: "), F.col("deaths").cast("string"),
        F.lit(" artigos\n- Hospitalização: "), F.col("hospitalization").cast("string"),
        F.lit(" artigos\n- Vacinação: "), F.col("vaccination").cast("string"), F.lit(" artigos\n"),
        F.when((F.col("growth_rate") > 10) & (F.col("increase") > 0),
               F.lit("\n\nAs notícias refletem o aumento de casos observado nas métricas.")).otherwise(F.lit("")),
    )
    text = F.when(F.col("articles") == 0, F.lit("Nenhuma notícia relevante encontrada para análise.")).otherwise(lines)
    return c.select("articles", "increase", "deaths", "hospitalization", "vaccination", "growth_rate", text.alias("analysis"))


def metric_explanations(bundle: DataFrame) -> DataFrame:
    """Fallback explanation per metric by threshold."""
    from ..functions.numbers import number_text

    r, m = F.col("rate"), F.col("metric")
    rt = number_text(r)
    text = (
        F.when((m == "case_increase_rate") & (r > 10), F.concat(F.lit("A taxa de aumento de "), rt, F.lit(
            "% é significativa e indica crescimento acelerado nos casos. Recomenda-se intensificar monitoramento.")))
        .when((m == "case_increase_rate") & (r > 0), F.concat(F.lit("A taxa de aumento de "), rt, F.lit(
            "% indica crescimento moderado. Manutenção de vigilância é recomendada.")))
        .when(m == "case_increase_rate", F.lit("A taxa de aumento é estável ou em declínio, indicando tendência positiva."))
        .when(m == "mortality_rate", F.concat(F.lit("A taxa de mortalidade de "), rt, F.lit(
            "% reflete a gravidade dos casos. Monitorar recursos de saúde é essencial.")))
        .when((m == "icu_occupancy_rate") & (r > 80), F.concat(F.lit("Ocupação de UTI de "), rt, F.lit(
            "% está crítica. Ação imediata para aumento de capacidade é necessária.")))
        .when(m == "icu_occupancy_rate", F.concat(F.lit("Ocupação de UTI de "), rt, F.lit("% está dentro dos limites operacionais.")))
        .when((m == "vaccination_rate") & (r > 70), F.concat(F.lit("Taxa de vacinação de "), rt, F.lit(
            "% é boa e fornece proteção populacional.")))
        .when(m == "vaccination_rate", F.concat(F.lit("Taxa de vacinação de "), rt, F.lit(
            "% indica necessidade de intensificar campanhas.")))
    )
    return bundle.select("metric", "rate", text.alias("explanation"))


# ---------------------------------------------------------------- N11
def article_flow(df: DataFrame, as_of: str, k: int = P.PIPELINE_MAX_ARTICLES) -> DataFrame:
    """Term + date filter -> title dedup -> relevance -> top-k -> themes,
    with the list date as dd/MM/yyyy."""
    kept = article_recency(article_term_filter(df), as_of)
    top = article_topk(article_relevance(article_dedupe(kept)), k)
    return _with_text(top).select(*ARTICLE_COLS, "relevance_score",
                      F.array_join(themes_expr(text=_t()), "|").alias("themes"),
                      F.date_format("published", "dd/MM/yyyy").alias("published_br"))
