"""Epidemiological rates.

Plan shape: the case table is scanned **once** into a per-day summary
(``daily_summary``: one row per notification day with the counters of
every rate).  That aggregate runs with map-side partial aggregation, so
the shuffle carries at most (days x map tasks) rows no matter how many
cases there are, and a hot day is combined before it is shuffled.
Reference-date adjustment (a global max over the per-day rows) and the
windowed counts of all four rates are then evaluated on that small
table in the same plan, so the case table is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numbers import ratio_units, round_ratio, tenths_text
from .cleaning import _present

RATE_ORDER = ["case_increase_rate", "mortality_rate", "icu_occupancy_rate", "vaccination_rate"]


def _vaccinated_expr(df: DataFrame) -> Column:
    doses = _present(df, P.RATE_DOSE_COLUMNS)
    if not doses:
        return F.lit(False)
    return F.coalesce(*[F.col(c) for c in doses]).isNotNull() if len(doses) > 1 else F.col(doses[0]).isNotNull()


def daily_summary(cases: DataFrame, date_col: str = P.DATE_COL) -> DataFrame:
    """One row per day: cases, deaths, ICU, vaccinated and per-dose counts."""
    cols = set(cases.columns)
    deaths = F.col("TEVE_OBITO") if "TEVE_OBITO" in cols else (
        F.col(P.OUTCOME_COL).isin(P.DEATH_CODES).cast("int") if P.OUTCOME_COL in cols else F.lit(0))
    icu = F.col("TEVE_UTI") if "TEVE_UTI" in cols else (
        (F.col(P.ICU_COL) == "1").cast("int") if P.ICU_COL in cols else F.lit(0))
    aggs = [
        F.count(F.lit(1)).alias("cases"),
        F.sum(F.coalesce(deaths, F.lit(0))).cast("bigint").alias("deaths"),
        F.sum(F.coalesce(icu, F.lit(0))).cast("bigint").alias("icu"),
        F.count_if(_vaccinated_expr(cases)).alias("vaccinated"),
    ]
    for name, col in P.DOSE_BREAKDOWN:
        aggs.append((F.count(F.col(col)) if col in cols else F.lit(0).cast("bigint")).alias(name))
    return (cases.where(F.col(date_col).isNotNull())
            .groupBy(F.col(date_col).alias("day")).agg(*aggs))


def reference_frame(daily: DataFrame, reference_date: str, now: str | None = None,
                    historical_days: int = P.HISTORICAL_DAYS) -> DataFrame:
    """M7 as a 1-row frame: ``ref`` = max day when data is older than
    ``now - historical_days`` days, else the given reference date."""
    ref = F.to_date(F.lit(reference_date))
    stats = daily.agg(F.max("day").alias("max_date"), F.sum("cases").alias("total_records"))
    if now is None:
        adjusted = ref
    else:
        cutoff = F.date_sub(F.to_date(F.lit(now)), historical_days)
        adjusted = F.when(F.col("max_date") < cutoff, F.col("max_date")).otherwise(ref)
    return stats.select(
        "max_date",
        F.coalesce(F.col("total_records"), F.lit(0)).cast("bigint").alias("total_records"),
        ref.alias("requested_date"),
        F.coalesce(adjusted, ref).alias("ref"),
    )


def _window_sum(col: str, lo: Column, hi: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("day").between(lo, hi), F.col(col))), F.lit(0)).cast("bigint")


def _band_text(rate_units: Column, num: Column, den: Column, zero_text: str,
               bands: list[tuple[int, str]], last: str, suffix: str = "") -> Column:
    """Interpretation: thresholds on the *unrounded* ratio (integer compare)."""
    txt = tenths_text(rate_units)
    expr = F.when(num == 0, F.lit(zero_text))
    for limit, label in bands:
        expr = expr.when(num * 100 < den * limit, F.concat(F.lit(label), txt, F.lit("%" + suffix)))
    return expr.otherwise(F.concat(F.lit(last), txt, F.lit("%" + suffix)))


def _adjusted_ref(reference_date: str, now: str | None, max_date: Column,
                  historical_days: int = P.HISTORICAL_DAYS) -> Column:
    ref = F.to_date(F.lit(reference_date))
    if now is None:
        return ref
    cutoff = F.date_sub(F.to_date(F.lit(now)), historical_days)
    return F.coalesce(F.when(max_date < cutoff, max_date).otherwise(ref), ref)


def newest_date(cases: DataFrame, col: str = P.DATE_COL) -> DataFrame:
    """The newest date as a 1-row frame ``_max``.  On a table partitioned by
    year and month the newest month comes from the partitions, and only that
    month's rows are read."""
    if {"ANO", "MES"} <= set(cases.columns):
        ym = F.col("ANO") * 100 + F.col("MES")
        cases = cases.where(ym == cases.agg(F.max(ym)).scalar())
    return cases.agg(F.max(col).alias("_max"))


def months_between(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Rows whose partition can hold dates of [lo, hi]; all rows of a frame
    without partition columns."""
    if not {"ANO", "MES"} <= set(df.columns):
        return df
    ym = F.col("ANO") * 100 + F.col("MES")
    return df.where((ym >= F.year(lo) * 100 + F.month(lo)) & (ym <= F.year(hi) * 100 + F.month(hi)))


def _no_doses(cases: DataFrame) -> bool:
    """Whether vaccination is not recorded: no dose column in the cases, or no
    ``vaccinated`` in their daily rollup."""
    return not _present(cases, P.RATE_DOSE_COLUMNS) and "vaccinated" not in cases.columns


def _windowed(cases: DataFrame, reference_date: str, now: str | None,
              spec: dict[str, tuple[int, int, str]]) -> DataFrame:
    """The windowed sums of ``spec`` (name -> (days back from, days back to,
    column)) in a 1-row frame with ``ref`` and ``total_records``.

    ``cases`` is the case table or its daily rollup.  Of the case table, the
    newest date and the row count enter as scalar subqueries, so the one
    scan that reads columns is cut to the months of the longest window.
    """
    if {"day", "cases"} <= set(cases.columns):
        return _windowed_rollup(cases, reference_date, now, spec)
    ref = newest_date(cases).select(_adjusted_ref(reference_date, now, F.col("_max")).alias("ref")).scalar()
    counted = cases.where("ANO is not null") if "ANO" in cases.columns else cases.where(F.col(P.DATE_COL).isNotNull())
    total = counted.agg(F.count(F.lit(1))).scalar()
    start = F.date_sub(ref, max(back for back, _, _ in spec.values()))
    window = months_between(cases, start, ref).where(F.col(P.DATE_COL).between(start, ref))
    aggs = [_window_sum(col, F.date_sub(ref, a), F.date_sub(ref, b)).alias(name) for name, (a, b, col) in spec.items()]
    return daily_summary(window).agg(*aggs).select(ref.alias("ref"), total.cast("bigint").alias("total_records"), *spec)


def _windowed_rollup(daily: DataFrame, reference_date: str, now: str | None,
                     spec: dict[str, tuple[int, int, str]]) -> DataFrame:
    """``_windowed`` over the daily rollup: one scan and one exchange.  Its
    days, one entry each and so bounded by the calendar, are gathered in one
    row together with the newest of them, from which the windows follow."""
    used = [c for c in dict.fromkeys(col for _, _, col in spec.values()) if c in daily.columns]
    rows = daily.agg(F.max("day").alias("_max"), F.coalesce(F.sum("cases"), F.lit(0)).cast("bigint").alias("total_records"),
                     F.collect_list(F.struct("day", *used)).alias("_days"))
    rows = rows.select(_adjusted_ref(reference_date, now, F.col("_max")).alias("ref"), "total_records", "_days")

    def windowed(a: int, b: int, col: str) -> Column:
        if col not in used:
            return F.lit(0).cast("bigint")
        inside = lambda d: d["day"].between(F.date_sub("ref", a), F.date_sub("ref", b))
        return F.aggregate("_days", F.lit(0).cast("bigint"), lambda s, d: s + F.when(inside(d), d[col]).otherwise(0))

    return rows.select("ref", "total_records", *[windowed(*window).alias(name) for name, window in spec.items()])


# ------------------------------------------------------------------ M1
def case_increase_rate(cases: DataFrame, reference_date: str, period_days: int = 30,
                       now: str | None = None) -> DataFrame:
    """Current window [ref-p, ref] vs previous [ref-2p, ref-p]; the boundary
    day belongs to both windows."""
    w = _windowed(cases, reference_date, now, {"current_cases": (period_days, 0, "cases"),
                               "previous_cases": (2 * period_days, period_days, "cases")})
    c, p = F.col("current_cases"), F.col("previous_cases")
    diff = c - p
    units = ratio_units(diff, p, 2, 1)
    rate = F.when(p == 0, F.when(c == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(round_ratio(diff, p, 2, 2))
    interp = (
        F.when(F.col("total_records") == 0, F.lit("Sem dados disponíveis para o período analisado"))
        .when((p == 0) & (c == 0), F.lit("Sem casos em ambos os períodos"))
        .when(p == 0, F.lit("Novos casos identificados"))
        .when(diff > 0, F.concat(F.lit("Aumento de "), tenths_text(units), F.lit("% em relação ao período anterior")))
        .when(diff < 0, F.concat(F.lit("Diminuição de "), tenths_text(units), F.lit("% em relação ao período anterior")))
        .otherwise(F.lit("Número de casos estável"))
    )
    r = F.col("ref")
    return w.select(
        F.lit("case_increase_rate").alias("metric"),
        r.alias("reference_date"),
        F.date_sub(r, period_days).alias("current_start"), r.alias("current_end"),
        F.date_sub(r, 2 * period_days).alias("previous_start"), F.date_sub(r, period_days).alias("previous_end"),
        c.alias("current_cases"), p.alias("previous_cases"), diff.alias("absolute_change"),
        F.when(F.col("total_records") == 0, F.lit(0.0)).otherwise(rate).alias("rate"),
        interp.alias("interpretation"),
    )


def case_increase_presets(cases: DataFrame, reference_date: str, presets: dict[str, int] = P.PERIOD_PRESETS,
                          now: str | None = None) -> DataFrame:
    """M1 for every preset period, a row each, from one scan: ``preset``,
    ``period_days``, both counts and the rate as ``case_increase_rate`` has it."""
    spec = {f"{side}_{name}": window for name, days in presets.items()
            for side, window in (("current", (days, 0, "cases")), ("previous", (2 * days, days, "cases")))}
    w = _windowed(cases, reference_date, now, spec)

    def row(name: str, days: int) -> Column:
        c, p = F.col(f"current_{name}"), F.col(f"previous_{name}")
        rate = F.when(p == 0, F.when(c == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(round_ratio(c - p, p, 2, 2))
        return F.struct(F.lit(name).alias("preset"), F.lit(days).alias("period_days"), F.col("ref").alias("reference_date"), c.alias("current_cases"), p.alias("previous_cases"),
                        (c - p).alias("absolute_change"), F.when(F.col("total_records") == 0, F.lit(0.0)).otherwise(rate).alias("rate"))

    return w.select(F.inline(F.array(*[row(name, days) for name, days in presets.items()])))


# ------------------------------------------------------------------ M2
def mortality_rate(cases: DataFrame, reference_date: str, period_days: int = 90,
                   now: str | None = None) -> DataFrame:
    w = _windowed(cases, reference_date, now, {"total_cases": (period_days, 0, "cases"), "deaths": (period_days, 0, "deaths")})
    n, d = F.col("deaths"), F.col("total_cases")
    interp = F.when(d == 0, F.lit("Sem dados para o período analisado")).otherwise(
        _band_text(ratio_units(n, d, 2, 1), n, d, "Nenhum óbito registrado no período",
                   [(5, "Taxa de mortalidade baixa: "), (15, "Taxa de mortalidade moderada: ")],
                   "Taxa de mortalidade alta: "))
    r = F.col("ref")
    return w.select(
        F.lit("mortality_rate").alias("metric"), r.alias("reference_date"),
        F.date_sub(r, period_days).alias("start_date"), r.alias("end_date"),
        d.alias("total_cases"), n.alias("deaths"),
        round_ratio(n, d).alias("rate"),
        F.when(d == 0, F.lit(None).cast("double")).otherwise(round_ratio(d - n, d)).alias("survival_rate"),
        interp.alias("interpretation"),
    )


# ------------------------------------------------------------------ M3
def icu_rate(cases: DataFrame, reference_date: str, period_days: int = 30,
             now: str | None = None) -> DataFrame:
    """ICU cases over **all** cases of the window (not only hospitalised)."""
    w = _windowed(cases, reference_date, now, {"total_hospitalized": (period_days, 0, "cases"), "icu_cases": (period_days, 0, "icu")})
    n, d = F.col("icu_cases"), F.col("total_hospitalized")
    interp = F.when(d == 0, F.lit("Sem dados para o período analisado")).otherwise(
        _band_text(ratio_units(n, d, 2, 1), n, d, "Nenhuma internação em UTI registrada",
                   [(20, "Taxa de UTI baixa: "), (40, "Taxa de UTI moderada: ")],
                   "Taxa de UTI alta: ", " - casos graves"))
    r = F.col("ref")
    return w.select(
        F.lit("icu_occupancy_rate").alias("metric"), r.alias("reference_date"),
        F.date_sub(r, period_days).alias("start_date"), r.alias("end_date"),
        d.alias("total_hospitalized"), n.alias("icu_cases"), (d - n).alias("non_icu_cases"),
        round_ratio(n, d).alias("rate"), interp.alias("interpretation"),
    )


# ------------------------------------------------------------------ M4
def vaccination_rate(cases: DataFrame, reference_date: str, period_days: int = 90,
                     now: str | None = None) -> DataFrame:
    """Vaccinated = any dose date present."""
    spec = {"total_cases": (period_days, 0, "cases"), "vaccinated_cases": (period_days, 0, "vaccinated")}
    w = _windowed(cases, reference_date, now, spec)
    n, d = F.col("vaccinated_cases"), F.col("total_cases")
    no_cols = _no_doses(cases)
    empty = (d == 0) | F.lit(no_cols)
    interp = F.when(empty, F.lit("Dados de vacinação não disponíveis para o período")).otherwise(
        _band_text(ratio_units(n, d, 2, 1), n, d, "Nenhum caso vacinado identificado no período",
                   [(30, "Taxa de vacinação baixa: "), (70, "Taxa de vacinação moderada: ")],
                   "Taxa de vacinação alta: "))
    r = F.col("ref")
    return w.select(
        F.lit("vaccination_rate").alias("metric"), r.alias("reference_date"),
        F.date_sub(r, period_days).alias("start_date"), r.alias("end_date"),
        F.when(empty, 0).otherwise(d).cast("bigint").alias("total_cases"),
        F.when(empty, 0).otherwise(n).cast("bigint").alias("vaccinated_cases"),
        F.when(empty, 0).otherwise(d - n).cast("bigint").alias("unvaccinated_cases"),
        F.when(empty, 0.0).otherwise(round_ratio(n, d)).alias("rate"),
        interp.alias("interpretation"),
    )


def dose_breakdown(cases: DataFrame, reference_date: str, period_days: int = 90,
                   now: str | None = None) -> DataFrame:
    """Per-dose counts in the window, long form; 3 zero rows when empty."""
    spec = {"total_cases": (period_days, 0, "cases")}
    spec.update({name: (period_days, 0, name) for name, _ in P.DOSE_BREAKDOWN})
    w = _windowed(cases, reference_date, now, spec)
    no_cols = _no_doses(cases)
    empty = (F.col("total_cases") == 0) | F.lit(no_cols)
    stacked = w.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("dose"), F.col(name).alias("cases"))
        for i, (name, _) in enumerate(P.DOSE_BREAKDOWN)])).alias("s"), empty.alias("empty"))
    return (stacked.where(~F.col("empty") | (F.col("s.position") < 3))
            .select("s.dose", F.when(F.col("empty"), 0).otherwise(F.col("s.cases")).cast("bigint").alias("cases")))


# ------------------------------------------------------------------ M7
def adjust_reference_date(cases: DataFrame, reference_date: str, now: str,
                          historical_days: int = P.HISTORICAL_DAYS) -> DataFrame:
    daily = cases if {"day", "cases"} <= set(cases.columns) else daily_summary(cases)
    ref = reference_frame(daily, reference_date, now, historical_days)
    return ref.select("max_date", "requested_date", F.col("ref").alias("reference_date"),
                      (F.col("ref") != F.col("requested_date")).alias("adjusted"))


# ------------------------------------------------------------------ M8 / M9
def metrics_bundle(cases: DataFrame, reference_date: str, windows: P.Windows = P.Windows(),
                   now: str | None = None) -> DataFrame:
    """All four rates from a single scan, long form (one row per metric)."""
    g, m, i, v = windows.growth, windows.mortality, windows.icu, windows.vaccination
    w = _windowed(cases, reference_date, now, {
        "g_cur": (g, 0, "cases"), "g_prev": (2 * g, g, "cases"),
        "m_total": (m, 0, "cases"), "m_deaths": (m, 0, "deaths"),
        "i_total": (i, 0, "cases"), "i_icu": (i, 0, "icu"),
        "v_total": (v, 0, "cases"), "v_vacc": (v, 0, "vaccinated"),
    })
    no_vax = _no_doses(cases)
    gc, gp = F.col("g_cur"), F.col("g_prev")
    rows = [
        ("case_increase_rate", g, gc - gp, gp,
         F.when(gp == 0, F.when(gc == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(round_ratio(gc - gp, gp))),
        ("mortality_rate", m, F.col("m_deaths"), F.col("m_total"), round_ratio(F.col("m_deaths"), F.col("m_total"))),
        ("icu_occupancy_rate", i, F.col("i_icu"), F.col("i_total"), round_ratio(F.col("i_icu"), F.col("i_total"))),
        ("vaccination_rate", v, F.lit(0).cast("bigint") if no_vax else F.col("v_vacc"), F.col("v_total"),
         F.lit(0.0) if no_vax else round_ratio(F.col("v_vacc"), F.col("v_total"))),
    ]
    structs = [F.struct(F.lit(name).alias("metric"), F.lit(days).alias("period_days"),
                        num.cast("bigint").alias("numerator"), den.cast("bigint").alias("denominator"),
                        rate.alias("rate"))
               for name, days, num, den, rate in rows]
    return w.select(F.col("ref").alias("reference_date"), "total_records",
                    F.explode(F.array(*structs)).alias("m")).select(
        "m.metric", "m.period_days", "reference_date", "m.numerator", "m.denominator", "m.rate", "total_records")


def metric_bands(bundle: DataFrame) -> DataFrame:
    """M9: band of each bundle rate, tested on the unrounded ratio."""
    n, d, m = F.col("numerator"), F.col("denominator"), F.col("metric")
    cuts = {"mortality_rate": (5, 15), "icu_occupancy_rate": (20, 40), "vaccination_rate": (30, 70)}
    band = F.when((m == "case_increase_rate") & (d == 0), F.when(n == 0, "zero").otherwise("new"))
    band = band.when(m == "case_increase_rate", F.when(n > 0, "increase").when(n < 0, "decrease").otherwise("stable"))
    band = band.when(d == 0, "no_data").when(n == 0, "zero")
    for metric, (lo, hi) in cuts.items():
        band = band.when((m == metric) & (n * 100 < d * lo), "low").when((m == metric) & (n * 100 < d * hi), "moderate")
    band = band.otherwise("high")
    units = ratio_units(n, d, 2, 1)
    return bundle.select("metric", "rate", band.alias("band"),
                         F.when(d == 0, F.lit(None)).otherwise(tenths_text(units)).alias("rate_text"))


# ------------------------------------------------------------------ M5 / M6
def metric_limits(bundle: DataFrame, limits: DataFrame) -> DataFrame:
    """Join rates to their limits (a fixed 4-row table, broadcast) and flag them."""
    from ..functions.numbers import number_text

    j = bundle.select("metric", "rate").join(F.broadcast(limits), "metric", "left")
    rate = F.coalesce(F.col("rate"), F.lit(0.0))
    rt = number_text(rate)
    status = (F.when(F.col("min_value").isNull(), F.lit(None))
              .when(F.col("rate") < F.col("min_value"), "below_min")
              .when(F.col("rate") > F.col("max_value"), "above_max")
              .when(F.col("rate") > F.col("warning_threshold"), "above_warning"))
    msg = (F.when(status == "below_min", F.concat(F.col("metric"), F.lit(": valor abaixo do mínimo ("), rt, F.lit(" < "), number_text(F.col("min_value")), F.lit(")")))
           .when(status == "above_max", F.concat(F.col("metric"), F.lit(": valor acima do máximo ("), rt, F.lit(" > "), number_text(F.col("max_value")), F.lit(")")))
           .when(status == "above_warning", F.concat(F.col("metric"), F.lit(": valor alto, requer atenção ("), rt, F.lit("%)"))))
    invalid = F.col("rate").isNull()
    return j.select(
        "metric", rate.alias("rate"), "min_value", "max_value", "warning_threshold",
        status.alias("status"),
        F.when(invalid, F.concat(F.col("metric"), F.lit(": valor inválido (nan)"))).otherwise(msg).alias("warning"),
        F.when(invalid, F.lit("Valor indisponível devido a erro de cálculo")).alias("override_interpretation"),
    )


def metric_alerts(bundle: DataFrame, thresholds: DataFrame, validation: DataFrame) -> DataFrame:
    """M6: alert level from warning/critical (or coverage) thresholds, plus the
    min/max validity test of the second limit table."""
    from ..functions.numbers import number_text

    th = thresholds.groupBy("metric").pivot("kind", ["warning", "critical", "low_coverage", "good_coverage"]).agg(F.first("value"))
    j = bundle.select("metric", "rate").join(F.broadcast(th), "metric", "left").join(F.broadcast(validation), "metric", "left")
    r = F.col("rate")
    level = (F.when(F.col("metric") == "vaccination_rate",
                    F.when(r < F.col("low_coverage"), "low").when(r > F.col("good_coverage"), "good").otherwise("adequate"))
             .when(r > F.col("critical"), "critical").when(r > F.col("warning"), "warning").otherwise("normal"))
    valid = ~((r < F.col("min_value")) | (r > F.col("max_value")))
    msg = (F.when(r < F.col("min_value"), F.concat(F.lit("Valor "), number_text(r), F.lit(" abaixo do mínimo "), number_text(F.col("min_value"))))
           .when(r > F.col("max_value"), F.concat(F.lit("Valor "), number_text(r), F.lit(" acima do máximo "), number_text(F.col("max_value"))))
           .otherwise(F.lit("Valor dentro dos limites")))
    return j.select("metric", "rate", level.alias("alert_level"), valid.alias("valid"), msg.alias("message"))


# ------------------------------------------------------------------ M10
def rates_by_group(cases: DataFrame, reference_date: str, by: str = P.STATE_COL,
                   windows: P.Windows = P.Windows()) -> DataFrame:
    """Mortality, ICU and vaccination rates per group in one aggregate.

    The reference date is fixed here, so the widest window is a plain
    range filter that reaches the scan; a hot group is combined map-side.
    """
    r = F.to_date(F.lit(reference_date))
    d = F.col(P.DATE_COL)
    widest = max(windows.mortality, windows.icu, windows.vaccination)
    in_m = d.between(F.date_sub(r, windows.mortality), r)
    in_i = d.between(F.date_sub(r, windows.icu), r)
    in_v = d.between(F.date_sub(r, windows.vaccination), r)
    cols = set(cases.columns)
    death = F.col("TEVE_OBITO") == 1 if "TEVE_OBITO" in cols else F.lit(False)
    icu = F.col("TEVE_UTI") == 1 if "TEVE_UTI" in cols else F.lit(False)
    vac = _vaccinated_expr(cases)
    import datetime as _dt

    from .filters import partition_window

    start = (_dt.date.fromisoformat(reference_date) - _dt.timedelta(days=widest)).isoformat()
    scoped = partition_window(cases, start, reference_date)
    agg = (scoped.where(d.between(F.date_sub(r, widest), r)).groupBy(by).agg(
        F.count_if(in_m).alias("cases_mortality_window"),
        F.count_if(in_m & death).alias("deaths"),
        F.count_if(in_i).alias("cases_icu_window"),
        F.count_if(in_i & icu).alias("icu_cases"),
        F.count_if(in_v).alias("cases_vaccination_window"),
        F.count_if(in_v & vac).alias("vaccinated_cases"),
    ))
    return agg.select(
        "*",
        round_ratio(F.col("deaths"), F.col("cases_mortality_window")).alias("mortality_rate"),
        round_ratio(F.col("icu_cases"), F.col("cases_icu_window")).alias("icu_rate"),
        round_ratio(F.col("vaccinated_cases"), F.col("cases_vaccination_window")).alias("vaccination_rate"),
    )
