"""Report tables (R1-R5): executive summary, vaccination split, Brazilian
instant formatting and key figures.  All inputs are 1-row or few-row
frames derived from the metric bundle and the article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numbers import number_text, round_ratio


def _rate(bundle: DataFrame, metric: str) -> Column:
    return F.max(F.when(F.col("metric") == metric, F.col("rate")))


def bundle_wide(bundle: DataFrame) -> DataFrame:
    """The four rates of the long bundle as one row."""
    return bundle.agg(*[_rate(bundle, m).alias(m) for m in
                        ("case_increase_rate", "mortality_rate", "icu_occupancy_rate", "vaccination_rate")],
                      F.count(F.lit(1)).alias("metrics_count"))


def executive_summary(bundle: DataFrame, context: DataFrame) -> DataFrame:
    """One sentence per metric by threshold, joined with '. ' plus a final '.'."""
    w = bundle_wide(bundle).crossJoin(F.broadcast(context.select("context_score")))
    g, m, i, s = F.col("case_increase_rate"), F.col("mortality_rate"), F.col("icu_occupancy_rate"), F.col("context_score")
    growth = (F.when(g > 10, F.concat(F.lit("Observado aumento significativo de "), number_text(g), F.lit("% nos casos")))
              .when(g < -10, F.concat(F.lit("Observada diminuição de "), number_text(F.abs(g)), F.lit("% nos casos")))
              .otherwise(F.lit("Número de casos relativamente estável")))
    mort = (F.when(m > 15, F.concat(F.lit("Taxa de mortalidade alta: "), number_text(m), F.lit("%")))
            .when(m < 5, F.concat(F.lit("Taxa de mortalidade baixa: "), number_text(m), F.lit("%")))
            .otherwise(F.concat(F.lit("Taxa de mortalidade moderada: "), number_text(m), F.lit("%"))))
    icu = (F.when(i > 40, F.concat(F.lit("Alta demanda por UTI: "), number_text(i), F.lit("% dos casos")))
           .otherwise(F.concat(F.lit("Demanda por UTI: "), number_text(i), F.lit("% dos casos"))))
    news = (F.when(s > 7, F.lit("Notícias confirmam tendências observadas nas métricas"))
            .when(s > 4, F.lit("Notícias parcialmente relacionadas às métricas"))
            .otherwise(F.lit("Limitada correlação entre notícias e métricas")))
    return w.select(g.alias("case_increase_rate"), m.alias("mortality_rate"), i.alias("icu_occupancy_rate"), s.alias("context_score"),
                    F.concat(F.concat_ws(". ", growth, mort, icu, news), F.lit(".")).alias("executive_summary"))


def vaccination_split(vacc: DataFrame) -> DataFrame:
    """R2: vaccinated / unvaccinated percent of the window (0 when empty)."""
    t = F.col("total_cases")
    return vacc.select("total_cases", "vaccinated_cases", "unvaccinated_cases",
                       round_ratio(F.col("vaccinated_cases"), t).alias("vaccinated_pct"),
                       round_ratio(F.col("unvaccinated_cases"), t).alias("unvaccinated_pct"))


def format_instant_br(col: Column, tz: str = P.BR_TIMEZONE) -> Column:
    """Instant (naive taken as UTC) -> 'dd/MM/yyyy às HH:mm:ss' local time.

    Only for real instants; dates are formatted without conversion (a date
    pushed through UTC->local would print the previous day).
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), col.cast("timestamp_ntz"))
    return F.date_format(local, "dd/MM/yyyy 'às' HH:mm:ss")


def report_figures(bundle: DataFrame, daily: DataFrame, monthly: DataFrame, articles: DataFrame) -> DataFrame:
    """Number of metrics, of non-empty charts and of analysed articles."""
    b = bundle.agg(F.count(F.lit(1)).alias("metrics_count"))
    charts = (daily.agg((F.count(F.lit(1)) > 0).cast("int").alias("d"))
              .crossJoin(monthly.agg((F.count(F.lit(1)) > 0).cast("int").alias("m")))
              .select((F.col("d") + F.col("m")).alias("charts_generated")))
    a = articles.agg(F.count(F.lit(1)).alias("news_articles_analyzed"))
    return b.crossJoin(charts).crossJoin(a)
