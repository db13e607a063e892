"""Rates: window boundaries, zero denominators, bands, single scan."""

import datetime as dt

from pyspark.sql import functions as F

from epispark.operators import metrics as M


def _cases(spark, rows):
    return spark.createDataFrame(rows, "DT_NOTIFIC date, TEVE_OBITO int, TEVE_UTI int, DOSE_1_COV date, SG_UF_NOT string")


def test_boundary_day_counts_in_both_growth_windows(spark):
    ref = dt.date(2024, 3, 31)
    rows = [(ref - dt.timedelta(days=30), 0, 0, None, "A")]  # the shared boundary day
    out = M.case_increase_rate(_cases(spark, rows), "2024-03-31", 30).first()
    assert (out.current_cases, out.previous_cases, out.rate) == (1, 1, 0.0)
    assert out.interpretation == "Número de casos estável"


def test_growth_zero_previous(spark):
    rows = [(dt.date(2024, 3, 30), 0, 0, None, "A")]
    out = M.case_increase_rate(_cases(spark, rows), "2024-03-31", 30).first()
    assert (out.rate, out.interpretation) == (100.0, "Novos casos identificados")


def test_empty_input_gives_zero_rates(spark):
    empty = _cases(spark, [])
    assert M.mortality_rate(empty, "2024-03-31").first().interpretation == "Sem dados para o período analisado"
    assert M.icu_rate(empty, "2024-03-31").first().rate == 0.0
    v = M.vaccination_rate(empty, "2024-03-31").first()
    assert (v.rate, v.interpretation) == (0.0, "Dados de vacinação não disponíveis para o período")
    g = M.case_increase_rate(empty, "2024-03-31").first()
    assert (g.rate, g.interpretation) == (0.0, "Sem dados disponíveis para o período analisado")
    assert [r.dose for r in M.dose_breakdown(empty, "2024-03-31").collect()] == ["dose_1", "dose_2", "dose_booster"]


def test_mortality_rounding_and_bands(spark):
    d = dt.date(2024, 3, 1)
    rows = [(d, 1, 0, None, "A")] + [(d, 0, 0, None, "A")] * 7  # 1/8 = 12.5 %
    out = M.mortality_rate(_cases(spark, rows), "2024-03-31").first()
    assert (out.rate, out.survival_rate) == (12.5, 87.5)
    assert out.interpretation == "Taxa de mortalidade moderada: 12.5%"


def test_half_up_rate(spark):
    d = dt.date(2024, 3, 1)
    rows = [(d, 1, 0, None, "A")] + [(d, 0, 0, None, "A")] * 7 + [(d, 0, 0, None, "A")] * 0
    # 1/8 exactly 12.5 (a .x5 at 1 dp is rounded up in text)
    out = M.mortality_rate(_cases(spark, rows), "2024-03-31").first()
    assert out.interpretation.endswith("12.5%")


def test_reference_date_adjustment(spark):
    rows = [(dt.date(2001, 8, 1), 0, 0, None, "A")]
    r = M.adjust_reference_date(_cases(spark, rows), "2024-03-31", now="2024-03-31").first()
    assert (r.reference_date, r.adjusted) == (dt.date(2001, 8, 1), True)
    r2 = M.adjust_reference_date(_cases(spark, rows), "2002-01-01", now="2002-01-01").first()
    assert (r2.reference_date, r2.adjusted) == (dt.date(2002, 1, 1), False)


def test_bundle_matches_single_metrics_and_states_sum(spark):
    d = dt.date(2024, 3, 20)
    rows = [(d, i % 3 == 0, i % 4 == 0, d if i % 2 else None, "AB"[i % 2]) for i in range(40)]
    rows = [(a, int(b), int(c), e, f) for a, b, c, e, f in rows]
    cases = _cases(spark, rows)
    b = {r.metric: r.rate for r in M.metrics_bundle(cases, "2024-03-31").collect()}
    assert b["mortality_rate"] == M.mortality_rate(cases, "2024-03-31").first().rate
    assert b["icu_occupancy_rate"] == M.icu_rate(cases, "2024-03-31").first().rate
    assert b["vaccination_rate"] == M.vaccination_rate(cases, "2024-03-31").first().rate
    per_state = M.rates_by_group(cases, "2024-03-31").agg(F.sum("deaths"), F.sum("cases_mortality_window")).first()
    m = M.mortality_rate(cases, "2024-03-31").first()
    assert (per_state[0], per_state[1]) == (m.deaths, m.total_cases)


def test_metric_limits_messages(spark):
    bundle = spark.createDataFrame([("mortality_rate", 45.0), ("icu_occupancy_rate", -5.0), ("vaccination_rate", 25.0)],
                                   "metric string, rate double")
    from epispark import params as P

    limits = spark.createDataFrame(P.METRIC_LIMITS, "metric string, min_value double, max_value double, warning_threshold double")
    out = {r.metric: r for r in M.metric_limits(bundle, limits).collect()}
    assert out["mortality_rate"].warning == "mortality_rate: valor alto, requer atenção (45.0%)"
    assert out["icu_occupancy_rate"].warning == "icu_occupancy_rate: valor abaixo do mínimo (-5.0 < 0.0)"
    assert out["vaccination_rate"].warning is None


def test_presets_are_the_rates_of_their_periods(spark):
    from epispark import params as P
    from epispark.sources import fixtures as FX

    for cases in (FX.cases(spark, "/root/testdata/sf0.001"), FX.rollup(spark, "/root/testdata/sf0.001"), FX.rollup(spark, "/root/testdata/sf0.001").limit(0)):
        got = {r.preset: r for r in M.case_increase_presets(cases, "2001-06-01", now="2001-06-01").collect()}
        assert list(got) == list(P.PERIOD_PRESETS)
        for name, days in P.PERIOD_PRESETS.items():
            want = M.case_increase_rate(cases, "2001-06-01", days, now="2001-06-01").first()
            assert (got[name].period_days, got[name].current_cases, got[name].previous_cases, got[name].rate) == (days, want.current_cases, want.previous_cases, want.rate)
