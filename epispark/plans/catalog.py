"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the driver tables (through the fixture views) so its
work grows with the data.  Parameters are fixed per key and mirror the
defaults of the reference behaviour (windows, lists, limits); the
reference date of the fixture is ``params.FIXTURE_AS_OF``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numbers import to_number
from ..operators import cleaning as C
from ..operators import filters as X
from ..operators import metrics as M
from ..operators import news as N
from ..operators import privacy as G
from ..operators import profile as A
from ..operators import quality as Q
from ..operators import report as R
from ..operators import series as S
from ..session import scratch_path
from ..sources import articles as SA
from ..sources import csv as CSV
from ..sources import fixtures as FX
from ..sources import loader as L
from ..sources import sinks as SK

AS_OF = P.FIXTURE_AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# ------------------------------------------------------------------ inputs
def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.raw_cases(spark, sf_dir)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.cases(spark, sf_dir)


def typed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned, typed columns (P1-P4) of the landed case table, without
    the derived fields: what the anonymisation step receives."""
    return cases(spark, sf_dir).select(*raw(spark, sf_dir).columns)


def arts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.articles(spark, sf_dir)


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.rollup(spark, sf_dir)


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metrics_bundle(rollup(spark, sf_dir), AS_OF, now=AS_OF)


NOTE_FIELD = "OBS;NOTA"  # quoted in the header, as it holds the separator


def fixture_csv(spark: SparkSession, sf_dir: str) -> str:
    """``raw_cases`` written once per session as ';'-separated CSV under the
    shared checkpoint folder (the landed-file form of the case table), with a
    note field: some notes hold line breaks, separators and quotes."""
    n = F.col("NU_NOTIFIC").cast("bigint")
    note = (F.when(n % 997 == 0, F.lit('linha 1\n\nlinha "2"; fim')).when(n % 991 == 0, F.lit("a;b")).when(n % 983 == 0, F.lit('dito ""isto""')))
    return FX.landed_path(spark, sf_dir, "raw_cases_csv", lambda: raw(spark, sf_dir).withColumn(NOTE_FIELD, note),
                          lambda df, path: df.write.mode("overwrite").option("header", True).option("sep", ";").option("escape", '"').csv(path))


def landed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CSV.scan_csv(spark, fixture_csv(spark, sf_dir)).withColumnRenamed(NOTE_FIELD, "OBS_NOTA")


def _limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.METRIC_LIMITS, "metric string, min_value double, max_value double, warning_threshold double")


# ------------------------------------------------------------------ S1-S9
@query("src_delimiter")
def q_src_delimiter(spark, sf_dir):
    return CSV.delimiter_frame(spark, fixture_csv(spark, sf_dir))


@query("src_project")
def q_src_project(spark, sf_dir):
    return CSV.scan_csv(spark, fixture_csv(spark, sf_dir), project=P.ESSENTIAL_COLUMNS)


@query("src_csv_scan")
def q_src_csv_scan(spark, sf_dir):
    return landed_csv(spark, sf_dir)


@query("load_window")
def q_load_window(spark, sf_dir):
    return L.load_window(landed_csv(spark, sf_dir), "2000-06-01", AS_OF)


@query("load_with_fallback")
def q_load_with_fallback(spark, sf_dir):
    return L.load_with_fallback(raw(spark, sf_dir), "1994-06-01", AS_OF)


def api_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API articles as raw API records."""
    a = arts(spark, sf_dir).where(F.col("source_type") == "news_api")
    return a.select("article_id", "title", F.col("link").alias("url"), F.col("summary").alias("description"),
                    F.col("published").alias("publishedAt"), F.struct(F.col("source").alias("name")).alias("source"))


def landed_json(spark: SparkSession, sf_dir: str, source_type: str) -> str:
    """Articles of one source type as they are landed: feed entries a line
    each, API responses of several articles a line; every 97th id also leaves
    a line that broke off."""
    a = arts(spark, sf_dir).where(F.col("source_type") == source_type)
    broken = a.where(F.col("article_id") % 97 == 0).select(F.concat(F.lit('{"title": "broken off'), F.col("article_id")).alias("value"))
    if source_type == "rss":
        lines = a.select(F.to_json(F.struct("article_id", "title", "link", "summary", F.date_format("published", "d MMM yyyy 10:00:00 'GMT'").alias("published"), "source")).alias("value"))
    else:
        record = F.struct(*[F.when(F.col("publishedAt").isNotNull(), F.concat(F.col("publishedAt").cast("string"), F.lit("T10:00:00Z"))).alias(c) if c == "publishedAt" else F.col(c) for c in SA.API_COLUMNS])
        lines = (api_shaped(spark, sf_dir).groupBy(F.expr("article_id div 15")).agg(F.collect_list(record).alias("articles"))
                 .select(F.to_json(F.struct(F.lit("ok").alias("status"), "articles")).alias("value")))
    return FX.landed_path(spark, sf_dir, f"articles_{source_type}_json", lambda: lines.unionByName(broken), lambda df, path: df.write.mode("overwrite").text(path))


@query("articles_union")
def q_articles_union(spark, sf_dir):
    feed, _ = SA.read_feed(spark, landed_json(spark, sf_dir, "rss"))
    api, _ = SA.read_api(spark, landed_json(spark, sf_dir, "news_api"))
    return SA.articles_union(feed, api)


@query("articles_bad_lines")
def q_articles_bad_lines(spark, sf_dir):
    _, feed = SA.read_feed(spark, landed_json(spark, sf_dir, "rss"))
    _, api = SA.read_api(spark, landed_json(spark, sf_dir, "news_api"))
    return SA.bad_lines(("rss", feed), ("news_api", api))


@query("articles_fallback")
def q_articles_fallback(spark, sf_dir):
    return SA.with_fallback(SA.api_records(api_shaped(spark, sf_dir)), spark, AS_OF)


@query("sink_parquet_roundtrip")
def q_sink_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "cases_parquet")
    SK.save_processed(cases(spark, sf_dir), path)
    return SK.load_processed(spark, path)


@query("sink_replace_months")
def q_sink_replace_months(spark, sf_dir):
    """The table without its year-2000 deaths, then the months of that year
    written again whole; the other months' files are not touched."""
    path, all_cases = scratch_path(spark, "cases_months"), cases(spark, sf_dir)
    SK.save_processed(all_cases.where("ANO is null or ANO <> 2000 or TEVE_OBITO = 0"), path)
    SK.replace_months(all_cases.where("ANO = 2000"), path)
    return SK.load_processed(spark, path)


@query("sink_quality_document")
def q_sink_quality_document(spark, sf_dir):
    path = scratch_path(spark, "quality_document")
    SK.save_quality_document(SK.quality_document(Q.quality_report(raw(spark, sf_dir), FX.quality_state(spark, sf_dir)), f"{AS_OF}T00:00:00Z"), path)
    return SK.document_rows(SK.load_quality_document(spark, path))


@query("sink_quality_json")
def q_sink_quality_json(spark, sf_dir):
    path = scratch_path(spark, "quality_json")
    SK.save_quality_json(Q.quality_report(raw(spark, sf_dir), FX.quality_state(spark, sf_dir)), path)
    return SK.load_quality_json(spark, path)


# ------------------------------------------------------------------ P1-P15
@query("parse_dates")
def q_parse_dates(spark, sf_dir):
    return C.parse_dates(raw(spark, sf_dir)).select(
        "NU_NOTIFIC", "DT_NOTIFIC", "DT_EVOLUCA", "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC")


@query("clean_codes")
def q_clean_codes(spark, sf_dir):
    return C.clean_codes(raw(spark, sf_dir)).select("NU_NOTIFIC", "CS_SEXO", "UTI", "HOSPITAL", "EVOLUCAO")


@query("clean_age")
def q_clean_age(spark, sf_dir):
    return C.clean_age(raw(spark, sf_dir)).select("NU_NOTIFIC", "NU_IDADE_N")


@query("clean_symptoms")
def q_clean_symptoms(spark, sf_dir):
    return C.clean_symptoms(raw(spark, sf_dir)).select("NU_NOTIFIC", *[c for c in P.SYMPTOM_COLUMNS if c != "SATURACAO"])


@query("age_band")
def q_age_band(spark, sf_dir):
    return cases(spark, sf_dir).select("NU_NOTIFIC", "NU_IDADE_N", "FAIXA_ETARIA")


@query("outcome_label")
def q_outcome_label(spark, sf_dir):
    return cases(spark, sf_dir).select("NU_NOTIFIC", "EVOLUCAO", "EVOLUCAO_SIMPLES")


@query("icu_flag")
def q_icu_flag(spark, sf_dir):
    return cases(spark, sf_dir).select("NU_NOTIFIC", "UTI", "CASO_GRAVE", "TEVE_UTI")


@query("death_flag")
def q_death_flag(spark, sf_dir):
    return cases(spark, sf_dir).select("NU_NOTIFIC", "EVOLUCAO", "TEVE_OBITO")


@query("vaccination_status")
def q_vaccination_status(spark, sf_dir):
    return cases(spark, sf_dir).select("NU_NOTIFIC", "DOSE_1_COV", "STATUS_VACINAL_COVID")


@query("symptom_count")
def q_symptom_count(spark, sf_dir):
    return cases(spark, sf_dir).select("NU_NOTIFIC", "NUM_SINTOMAS")


@query("calendar_fields")
def q_calendar_fields(spark, sf_dir):
    return cases(spark, sf_dir).select("NU_NOTIFIC", "DT_NOTIFIC", "ANO", "MES", "SEMANA_EPI",
                                      F.expr("extract(YEAROFWEEK FROM DT_NOTIFIC)").cast("int").alias("ANO_SEMANA_EPI"))


@query("age_risk")
def q_age_risk(spark, sf_dir):
    return cases(spark, sf_dir).select("NU_NOTIFIC", "NU_IDADE_N", "GRUPO_RISCO_IDADE")


@query("decode_codes")
def q_decode_codes(spark, sf_dir):
    return C.decode_codes(cases(spark, sf_dir)).select("NU_NOTIFIC", "CS_SEXO_DESC", "UTI_DESC", "EVOLUCAO_DESC")


@query("age_from_birth")
def q_age_from_birth(spark, sf_dir):
    # The fixture has no birth date; the notification date plays that role.
    return cases(spark, sf_dir).select("NU_NOTIFIC", "DT_NOTIFIC",
                                       C.age_from_birth_expr("DT_NOTIFIC", AS_OF).alias("IDADE_CALCULADA"))


@query("decode_vaccination")
def q_decode_vaccination(spark, sf_dir):
    return C.decode_codes(C.clean_codes(FX.detailed_cases(spark, sf_dir))).select("NU_NOTIFIC", "VACINA_COV", "VACINA_COV_DESC")


@query("age_from_birth_date")
def q_age_from_birth_date(spark, sf_dir):
    return C.parse_dates(FX.detailed_cases(spark, sf_dir)).select("NU_NOTIFIC", "DT_NASC", C.age_from_birth_expr("DT_NASC", AS_OF).alias("IDADE_CALCULADA"))


@query("age_band_anonymised")
def q_age_band_anonymised(spark, sf_dir):
    anon = cases(spark, sf_dir).withColumn("NU_IDADE_N", C.anonymised_age_expr())
    return (anon.select(C.age_band_expr().alias("FAIXA_ETARIA"), C.age_risk_expr().alias("GRUPO_RISCO_IDADE"))
            .groupBy("FAIXA_ETARIA", "GRUPO_RISCO_IDADE").agg(F.count(F.lit(1)).alias("cases")))


# ------------------------------------------------------------------ X1-X6
@query("filter_date_range")
def q_filter_date_range(spark, sf_dir):
    return X.filter_date_range(cases(spark, sf_dir), "2001-03-03", AS_OF).select("NU_NOTIFIC", "DT_NOTIFIC", "EVOLUCAO")


@query("require_date")
def q_require_date(spark, sf_dir):
    return X.require_date(C.parse_dates(raw(spark, sf_dir))).select("NU_NOTIFIC", "DT_NOTIFIC")


@query("filter_temporal_order")
def q_filter_temporal_order(spark, sf_dir):
    return X.filter_temporal_order(cases(spark, sf_dir)).select("NU_NOTIFIC", "DT_NOTIFIC", "DT_EVOLUCA")


@query("drop_all_null")
def q_drop_all_null(spark, sf_dir):
    return X.drop_all_null(cases(spark, sf_dir)).select("NU_NOTIFIC", "DT_NOTIFIC", "SG_UF_NOT")


@query("filter_plausible_date")
def q_filter_plausible_date(spark, sf_dir):
    return X.filter_plausible_date(cases(spark, sf_dir), AS_OF).select("NU_NOTIFIC", "DT_NOTIFIC")


@query("filter_plausible_age")
def q_filter_plausible_age(spark, sf_dir):
    typed = raw(spark, sf_dir).select("NU_NOTIFIC", to_number("NU_IDADE_N").alias("NU_IDADE_N"))
    return X.filter_plausible_age(typed)


# ------------------------------------------------------------------ J1-J2, A1-A13, W1-W4, O2-O4
@query("daily_calendar_fill")
def q_daily_calendar_fill(spark, sf_dir):
    return S.daily_calendar_fill(rollup(spark, sf_dir), AS_OF, 30)


@query("metric_limits")
def q_metric_limits(spark, sf_dir):
    return M.metric_limits(bundle(spark, sf_dir), _limits(spark))


@query("daily_counts")
def q_daily_counts(spark, sf_dir):
    return S.daily_counts(rollup(spark, sf_dir), AS_OF, 30)


@query("monthly_counts")
def q_monthly_counts(spark, sf_dir):
    return S.monthly_counts(rollup(spark, sf_dir), AS_OF, 365)


@query("monthly_counts_fallback")
def q_monthly_counts_fallback(spark, sf_dir):
    return S.monthly_counts(rollup(spark, sf_dir), "2005-06-01", 365)


@query("value_counts_outcome")
def q_value_counts_outcome(spark, sf_dir):
    return A.value_counts(cases(spark, sf_dir), "EVOLUCAO")


@query("top_states")
def q_top_states(spark, sf_dir):
    return A.value_counts(cases(spark, sf_dir), "SG_UF_NOT", k=5, dropna=True)


@query("vaccination_distribution")
def q_vaccination_distribution(spark, sf_dir):
    return A.value_counts(cases(spark, sf_dir), "STATUS_VACINAL_COVID")


@query("completeness")
def q_completeness(spark, sf_dir):
    return A.completeness(cases(spark, sf_dir))


@query("age_summary")
def q_age_summary(spark, sf_dir):
    return A.age_summary(cases(spark, sf_dir))


@query("age_ranges")
def q_age_ranges(spark, sf_dir):
    return A.age_ranges(cases(spark, sf_dir))


@query("date_span")
def q_date_span(spark, sf_dir):
    return A.date_span(cases(spark, sf_dir))


@query("severity_indicators")
def q_severity_indicators(spark, sf_dir):
    return A.severity_indicators(cases(spark, sf_dir))


@query("daily_series_summary")
def q_daily_series_summary(spark, sf_dir):
    return S.series_summary(S.daily_calendar_fill(rollup(spark, sf_dir), AS_OF, 30), "date")


@query("monthly_series_summary")
def q_monthly_series_summary(spark, sf_dir):
    return S.series_summary(S.monthly_counts(rollup(spark, sf_dir), AS_OF, 365), "month_start")


@query("theme_breakdown")
def q_theme_breakdown(spark, sf_dir):
    return N.theme_breakdown(arts(spark, sf_dir))


@query("source_breakdown")
def q_source_breakdown(spark, sf_dir):
    return N.source_breakdown(arts(spark, sf_dir))


@query("data_summary")
def q_data_summary(spark, sf_dir):
    return A.data_summary(cases(spark, sf_dir))


@query("article_origin_counts")
def q_article_origin_counts(spark, sf_dir):
    return N.article_origin_counts(arts(spark, sf_dir))


@query("moving_average_7d")
def q_moving_average_7d(spark, sf_dir):
    return S.moving_average(S.daily_calendar_fill(rollup(spark, sf_dir), AS_OF, 30))


@query("dedupe_cases")
def q_dedupe_cases(spark, sf_dir):
    return A.dedupe_cases(cases(spark, sf_dir))


@query("duplicate_counts")
def q_duplicate_counts(spark, sf_dir):
    return A.duplicate_counts(cases(spark, sf_dir))


@query("article_dedupe")
def q_article_dedupe(spark, sf_dir):
    return N.article_dedupe(arts(spark, sf_dir))


@query("article_rank")
def q_article_rank(spark, sf_dir):
    return N.article_rank(N.article_relevance(arts(spark, sf_dir))).select("article_id", "title", "summary", "relevance_score", "rank")


@query("article_topk")
def q_article_topk(spark, sf_dir):
    return N.article_topk(N.article_relevance(arts(spark, sf_dir)), 10).select("article_id", "title", "relevance_score")


@query("theme_members")
def q_theme_members(spark, sf_dir):
    return N.theme_members(arts(spark, sf_dir))


@query("theme_top3")
def q_theme_top3(spark, sf_dir):
    return N.theme_top(arts(spark, sf_dir))


# ------------------------------------------------------------------ M1-M10
@query("case_increase_rate")
def q_case_increase_rate(spark, sf_dir):
    return M.case_increase_rate(rollup(spark, sf_dir), AS_OF, 30, now=AS_OF)


@query("case_increase_presets")
def q_case_increase_presets(spark, sf_dir):
    return M.case_increase_presets(rollup(spark, sf_dir), AS_OF, now=AS_OF)


@query("mortality_rate")
def q_mortality_rate(spark, sf_dir):
    return M.mortality_rate(rollup(spark, sf_dir), AS_OF, 90, now=AS_OF)


@query("icu_rate")
def q_icu_rate(spark, sf_dir):
    return M.icu_rate(rollup(spark, sf_dir), AS_OF, 30, now=AS_OF)


@query("vaccination_rate")
def q_vaccination_rate(spark, sf_dir):
    return M.vaccination_rate(rollup(spark, sf_dir), AS_OF, 90, now=AS_OF)


@query("dose_breakdown")
def q_dose_breakdown(spark, sf_dir):
    return M.dose_breakdown(rollup(spark, sf_dir), AS_OF, 90, now=AS_OF)


@query("metric_alerts")
def q_metric_alerts(spark, sf_dir):
    th = spark.createDataFrame(P.ALERT_THRESHOLDS, "metric string, kind string, value double")
    val = spark.createDataFrame(P.VALIDATION_LIMITS, "metric string, min_value double, max_value double")
    return M.metric_alerts(bundle(spark, sf_dir), th, val)


@query("adjust_reference_date")
def q_adjust_reference_date(spark, sf_dir):
    return M.adjust_reference_date(rollup(spark, sf_dir), AS_OF, now="2005-01-01")


@query("metrics_bundle")
def q_metrics_bundle(spark, sf_dir):
    return bundle(spark, sf_dir)


@query("metric_bands")
def q_metric_bands(spark, sf_dir):
    return M.metric_bands(bundle(spark, sf_dir))


@query("rates_by_state")
def q_rates_by_state(spark, sf_dir):
    return M.rates_by_group(cases(spark, sf_dir), AS_OF, "SG_UF_NOT")


# ------------------------------------------------------------------ Q1-Q11
@query("q_required")
def q_q_required(spark, sf_dir):
    return Q.q_required(raw(spark, sf_dir))


@query("q_null_profile")
def q_q_null_profile(spark, sf_dir):
    return Q.q_null_profile(raw(spark, sf_dir))


@query("q_types")
def q_q_types(spark, sf_dir):
    return Q.q_types(raw(spark, sf_dir))


@query("q_ranges")
def q_q_ranges(spark, sf_dir):
    return Q.q_ranges(raw(spark, sf_dir))


@query("q_categorical")
def q_q_categorical(spark, sf_dir):
    return Q.q_categorical(raw(spark, sf_dir))


@query("q_temporal")
def q_q_temporal(spark, sf_dir):
    return Q.q_temporal(raw(spark, sf_dir))


@query("q_temporal_pairs")
def q_q_temporal_pairs(spark, sf_dir):
    """All three date pairs of the temporal check."""
    return Q.q_temporal(FX.detailed_cases(spark, sf_dir))


@query("q_rule_icu")
def q_q_rule_icu(spark, sf_dir):
    return Q.q_rules(raw(spark, sf_dir), ["uti_requires_internment"])


@query("q_rule_death_symptoms")
def q_q_rule_death_symptoms(spark, sf_dir):
    return Q.q_rules(raw(spark, sf_dir), ["death_without_symptoms"])


@query("q_rule_doses")
def q_q_rule_doses(spark, sf_dir):
    return Q.q_rules(raw(spark, sf_dir), ["vaccination_consistency"])


@query("q_outliers_iqr")
def q_q_outliers_iqr(spark, sf_dir):
    return Q.q_outliers(raw(spark, sf_dir), method="iqr")


@query("q_outliers_percentile")
def q_q_outliers_percentile(spark, sf_dir):
    return Q.q_outliers(raw(spark, sf_dir), method="percentile")


@query("q_outliers_many_values")
def q_q_outliers_many_values(spark, sf_dir):
    """A code column of as many values as there are places."""
    return Q.q_outliers(raw(spark, sf_dir), field="CO_MUN_NOT", method="percentile", many_values=True)


@query("quality_score")
def q_quality_score(spark, sf_dir):
    return Q.quality_score(raw(spark, sf_dir), FX.quality_state(spark, sf_dir))


@query("quality_report")
def q_quality_report(spark, sf_dir):
    return Q.quality_report(raw(spark, sf_dir), FX.quality_state(spark, sf_dir))


# ------------------------------------------------------------------ G1-G10
@query("anonymise_columns")
def q_anonymise_columns(spark, sf_dir):
    return G.anonymise_columns(cases(spark, sf_dir))


@query("anonymise_age")
def q_anonymise_age(spark, sf_dir):
    return G.anonymise_age(typed_cases(spark, sf_dir)).select("NU_NOTIFIC", "NU_IDADE_N", "FAIXA_ETARIA")


@query("anonymise_cases")
def q_anonymise_cases(spark, sf_dir):
    return G.anonymise_cases(typed_cases(spark, sf_dir))


@query("redact_text")
def q_redact_text(spark, sf_dir):
    from ..functions.text import redact

    return arts(spark, sf_dir).select("article_id", redact("summary").alias("summary"))


@query("redact_frame")
def q_redact_frame(spark, sf_dir):
    a = arts(spark, sf_dir)
    nested = a.select("article_id", F.col("title").alias("nome_paciente"),
                      F.struct("title", "summary", F.col("link").alias("email_contato")).alias("detalhes"),
                      F.array("summary", "link").alias("trechos"),
                      F.create_map(F.lit("CPF_titular"), "title", F.lit("obs"), "summary").alias("mapa"))
    r = G.redact_frame(nested)
    return r.select("article_id", "nome_paciente", F.col("detalhes.title").alias("detalhes_title"),
                    F.col("detalhes.summary").alias("detalhes_summary"),
                    F.col("detalhes.email_contato").alias("detalhes_email_contato"),
                    F.array_join("trechos", " | ").alias("trechos"),
                    F.col("mapa")["CPF_titular"].alias("mapa_cpf"), F.col("mapa")["obs"].alias("mapa_obs"))


@query("article_appropriate")
def q_article_appropriate(spark, sf_dir):
    return arts(spark, sf_dir).select("article_id", G.article_appropriate_expr().alias("appropriate"))


@query("mask_terms")
def q_mask_terms(spark, sf_dir):
    from ..functions.text import mask

    return arts(spark, sf_dir).select("article_id", mask("summary").alias("summary"))


@query("report_fingerprint")
def q_report_fingerprint(spark, sf_dir):
    w = R.bundle_wide(bundle(spark, sf_dir))
    parts = [F.lit(AS_OF), F.col("metrics_count"), F.lit(P.GUARDRAILS_VERSION)]
    parts += [F.floor(F.col(m) * 100 + 0.5).cast("bigint") for m in M.RATE_ORDER]
    return w.select(F.lit(AS_OF).alias("report_date"), "metrics_count", G.fingerprint_expr(*parts).alias("signature"))


@query("pii_scan")
def q_pii_scan(spark, sf_dir):
    a = arts(spark, sf_dir)
    return G.pii_scan(a.withColumn("mapa", F.create_map(F.lit("obs"), F.array("title", "summary")))
                      .withColumn("detalhes", F.struct("link", F.struct("summary").alias("texto"))))


# ------------------------------------------------------------------ X7, X8, N1-N11
@query("article_recency")
def q_article_recency(spark, sf_dir):
    return N.article_recency(arts(spark, sf_dir), AS_OF).select("article_id", "published")


@query("article_term_filter")
def q_article_term_filter(spark, sf_dir):
    return N.article_term_filter(arts(spark, sf_dir)).select("article_id", "title")


@query("article_relevance")
def q_article_relevance(spark, sf_dir):
    return N.article_relevance(arts(spark, sf_dir)).select("article_id", "relevance_score")


@query("context_score")
def q_context_score(spark, sf_dir):
    return N.context_score(N.article_relevance(arts(spark, sf_dir)))


@query("article_themes")
def q_article_themes(spark, sf_dir):
    return N.article_themes(arts(spark, sf_dir))


@query("theme_counts_wide")
def q_theme_counts_wide(spark, sf_dir):
    return N.theme_counts_wide(arts(spark, sf_dir))


@query("search_funnel")
def q_search_funnel(spark, sf_dir):
    return N.search_funnel(arts(spark, sf_dir), AS_OF)


@query("matching_terms")
def q_matching_terms(spark, sf_dir):
    return N.matching_terms(arts(spark, sf_dir))


@query("truncate_summary")
def q_truncate_summary(spark, sf_dir):
    return N.truncate_summary(arts(spark, sf_dir))


@query("heuristic_analysis")
def q_heuristic_analysis(spark, sf_dir):
    growth = M.case_increase_rate(rollup(spark, sf_dir), AS_OF, 30, now=AS_OF).select(F.col("rate").alias("growth_rate"))
    return N.heuristic_analysis(N.article_relevance(arts(spark, sf_dir)), growth)


@query("metric_explanations")
def q_metric_explanations(spark, sf_dir):
    return N.metric_explanations(bundle(spark, sf_dir))


@query("article_flow")
def q_article_flow(spark, sf_dir):
    return N.article_flow(arts(spark, sf_dir), AS_OF)


# ------------------------------------------------------------------ R1-R4
@query("executive_summary")
def q_executive_summary(spark, sf_dir):
    ctx = N.context_score(N.article_relevance(arts(spark, sf_dir)))
    return R.executive_summary(bundle(spark, sf_dir), ctx)


@query("vaccination_split")
def q_vaccination_split(spark, sf_dir):
    return R.vaccination_split(M.vaccination_rate(rollup(spark, sf_dir), AS_OF, 90, now=AS_OF))


@query("format_instant_br")
def q_format_instant_br(spark, sf_dir):
    return FX.events(spark, sf_dir).select("event_id", R.format_instant_br(F.col("ts")).alias("ts_br"))


@query("report_figures")
def q_report_figures(spark, sf_dir):
    c = cases(spark, sf_dir)
    return R.report_figures(bundle(spark, sf_dir), S.daily_calendar_fill(c, AS_OF, 30),
                            S.monthly_counts(c, AS_OF, 365), N.article_flow(arts(spark, sf_dir), AS_OF))
