"""News scoring, dedup, ranking, and the case series."""

import datetime as dt

from pyspark.sql import functions as F

from epispark.operators import news as N
from epispark.operators import series as S


def _arts(spark, rows):
    return spark.createDataFrame(rows, "article_id long, title string, summary string, link string, published date, source string, source_type string")


def test_relevance_is_a_multiset(spark):
    a = _arts(spark, [(1, "Doença respiratória", "", "", None, "s", "rss"), (2, "nada aqui", "", "", None, "s", "rss")])
    got = {r.article_id: r.relevance_score for r in N.article_relevance(a).collect()}
    # 'respiratória' is listed twice; 'doença' once
    assert got == {1: 3}


def test_dedupe_keeps_first_and_drops_empty(spark):
    a = _arts(spark, [(3, " Casos ", "b", "", None, "s", "rss"), (1, "casos", "a", "", None, "s", "rss"),
                      (2, "", "c", "", None, "s", "rss"), (4, None, "d", "", None, "s", "rss")])
    assert [r.article_id for r in N.article_dedupe(a).collect()] == [1]


def test_rank_is_stable_and_global(spark):
    rows = [(i, "covid" if i % 2 else "covid uti", "", "", None, "s", "rss") for i in range(1, 41)]
    scored = N.article_relevance(_arts(spark, rows))
    ranked = N.article_rank(scored).orderBy("rank").collect()
    expect = sorted([(r.relevance_score, r.article_id) for r in scored.collect()], key=lambda t: (-t[0], t[1]))
    assert [(r.relevance_score, r.article_id) for r in ranked] == expect
    assert [r.rank for r in ranked] == list(range(1, 41))
    top = N.article_topk(scored, 3).collect()
    assert [r.article_id for r in top] == [2, 4, 6]


def test_context_score_caps(spark):
    a = _arts(spark, [(i, "casos aumento óbito uti vacina covid", "", "", None, "s", "rss") for i in range(30)])
    r = N.context_score(a).first()
    # 5 categories with some keywords each, bonus capped at 2.0, total capped at 10
    assert r.articles == 30 and r.context_score <= 10.0
    assert N.context_score(_arts(spark, [])).first().context_score == 0.0


def test_recency_keeps_undated(spark):
    a = _arts(spark, [(1, "t", "", "", None, "s", "rss"), (2, "t", "", "", dt.date(2000, 1, 1), "s", "rss"),
                      (3, "t", "", "", dt.date(2001, 5, 1), "s", "rss")])
    assert sorted(r.article_id for r in N.article_recency(a, "2001-06-01").collect()) == [1, 3]


def test_calendar_fill_and_moving_average(spark):
    cases = spark.createDataFrame([(dt.date(2024, 3, d),) for d in (1, 1, 3, 31)], "DT_NOTIFIC date")
    fill = S.daily_calendar_fill(cases, "2024-03-31", 30)
    rows = fill.orderBy("date").collect()
    assert len(rows) == 31 and rows[0].date == dt.date(2024, 3, 1) and rows[0].cases == 2
    ma = S.moving_average(fill).orderBy("date").collect()
    assert ma[5].moving_average_7d is None and abs(ma[6].moving_average_7d - 3 / 7) < 1e-12
    summ = S.series_summary(fill).first()
    assert (summ.total_cases, summ.peak_cases, summ.peak_date) == (4, 2, dt.date(2024, 3, 1))


def test_monthly_fallback_uses_latest_year(spark):
    cases = spark.createDataFrame([(dt.date(2001, 7, 1),), (dt.date(2000, 1, 1),)], "DT_NOTIFIC date")
    m = S.monthly_counts(cases, "2010-01-01", 365).collect()
    assert [(r.year, r.month, r.cases) for r in m] == [(2001, 7, 1)]


def test_dedupe_strips_all_edge_whitespace(spark):
    a = _arts(spark, [(2, "\tCasos\r", "b", "", None, "s", "rss"), (5, "casos", "a", "", None, "s", "rss"),
                      (7, " \t ", "c", "", None, "s", "rss")])
    assert [r.article_id for r in N.article_dedupe(a).collect()] == [2]
