"""DuckDB oracle SQL for every registered query.

Each statement restates the semantics in plain SQL over the driver's
base tables.  The fixture inputs (``raw_cases``, ``cases``, ``articles``)
are prepended as CTEs; ``cases`` is written here independently of the
Spark cleaning code (``try_strptime`` / ``TRY_CAST`` / ``CASE``).
"""

from __future__ import annotations

from ..sources.fixtures import ARTICLES_SQL, DETAILED_CASES_SQL, RAW_CASES_SQL

AS_OF = "DATE '2001-06-01'"

RAW_CASES_CTE = RAW_CASES_SQL.format(lineitem="lineitem", orders="orders", customer="customer", nation="nation")
ARTICLES_CTE = ARTICLES_SQL.format(documents="documents")


def _code(col: str, valid: str) -> str:
    v = f"trim(replace({col}, '.0', ''))"
    return f"CASE WHEN {v} IN ({valid}) THEN {v} END AS {col}"


TYPED_CTE = f"""
SELECT NU_NOTIFIC,
  CAST(try_strptime(DT_NOTIFIC, '%Y-%m-%d') AS DATE) AS DT_NOTIFIC,
  SG_UF_NOT, CO_MUN_NOT,
  {_code('CS_SEXO', "'M','F','I'")},
  CASE WHEN TRY_CAST(NU_IDADE_N AS DOUBLE) BETWEEN 0 AND 120 THEN TRY_CAST(NU_IDADE_N AS DOUBLE) END AS NU_IDADE_N,
  {_code('UTI', "'1','2','9'")},
  {_code('HOSPITAL', "'1','2','9'")},
  {_code('EVOLUCAO', "'1','2','3','9'")},
  CAST(try_strptime(DT_EVOLUCA, '%Y-%m-%d') AS DATE) AS DT_EVOLUCA,
  CAST(try_strptime(DOSE_1_COV, '%d/%m/%Y') AS DATE) AS DOSE_1_COV,
  CAST(try_strptime(DOSE_2_COV, '%d/%m/%Y') AS DATE) AS DOSE_2_COV,
  CAST(try_strptime(DOSE_REF, '%d/%m/%Y') AS DATE) AS DOSE_REF,
  CAST(try_strptime(DOSE_2REF, '%d/%m/%Y') AS DATE) AS DOSE_2REF,
  CAST(try_strptime(DOSE_ADIC, '%d/%m/%Y') AS DATE) AS DOSE_ADIC,
  TRY_CAST(FEBRE AS DOUBLE) AS FEBRE, TRY_CAST(TOSSE AS DOUBLE) AS TOSSE,
  TRY_CAST(DISPNEIA AS DOUBLE) AS DISPNEIA, TRY_CAST(DESC_RESP AS DOUBLE) AS DESC_RESP,
  TRY_CAST(DIARREIA AS DOUBLE) AS DIARREIA, TRY_CAST(VOMITO AS DOUBLE) AS VOMITO
FROM raw_cases
"""

CASES_CTE = """
SELECT *,
  CASE WHEN NU_IDADE_N >= 0 AND NU_IDADE_N <= 12 THEN 'Criança'
       WHEN NU_IDADE_N > 12 AND NU_IDADE_N <= 18 THEN 'Adolescente'
       WHEN NU_IDADE_N > 18 AND NU_IDADE_N <= 60 THEN 'Adulto'
       WHEN NU_IDADE_N > 60 AND NU_IDADE_N <= 120 THEN 'Idoso' END AS FAIXA_ETARIA,
  CASE EVOLUCAO WHEN '1' THEN 'Cura' WHEN '2' THEN 'Óbito' WHEN '3' THEN 'Óbito por outras causas' ELSE 'Ignorado' END AS EVOLUCAO_SIMPLES,
  CASE WHEN UTI = '1' THEN 1 ELSE 0 END AS CASO_GRAVE,
  CASE WHEN DOSE_2REF IS NOT NULL OR DOSE_ADIC IS NOT NULL THEN 'Com reforços adicionais'
       WHEN DOSE_REF IS NOT NULL THEN 'Com dose de reforço'
       WHEN DOSE_2_COV IS NOT NULL THEN 'Esquema completo (2 doses)'
       WHEN DOSE_1_COV IS NOT NULL THEN '1ª dose apenas'
       ELSE 'Não vacinado' END AS STATUS_VACINAL_COVID,
  (CASE WHEN FEBRE = 1 THEN 1 ELSE 0 END + CASE WHEN TOSSE = 1 THEN 1 ELSE 0 END
   + CASE WHEN DISPNEIA = 1 THEN 1 ELSE 0 END + CASE WHEN DESC_RESP = 1 THEN 1 ELSE 0 END
   + CASE WHEN DIARREIA = 1 THEN 1 ELSE 0 END + CASE WHEN VOMITO = 1 THEN 1 ELSE 0 END) AS NUM_SINTOMAS,
  CAST(year(DT_NOTIFIC) AS INTEGER) AS ANO,
  CAST(month(DT_NOTIFIC) AS INTEGER) AS MES,
  CAST(weekofyear(DT_NOTIFIC) AS INTEGER) AS SEMANA_EPI,
  CASE WHEN NU_IDADE_N >= 60 OR NU_IDADE_N < 2 THEN 'Alto' ELSE 'Baixo' END AS GRUPO_RISCO_IDADE,
  CASE WHEN EVOLUCAO IN ('2', '3') THEN 1 ELSE 0 END AS TEVE_OBITO,
  CASE WHEN UTI = '1' THEN 1 ELSE 0 END AS TEVE_UTI
FROM typed
"""

PREFIX = (f"WITH raw_cases AS ({RAW_CASES_CTE}),\n typed AS ({TYPED_CTE}),\n cases AS ({CASES_CTE}),\n"
          f" articles AS ({ARTICLES_CTE})\n")



# ===================================================================== helpers
ORACLE: dict[str, str] = {}
BODY: dict[str, str] = {}


def register(key: str, body: str) -> None:
    """Wrap a standalone statement (it may carry its own WITH) as a subquery
    under the fixture CTEs; keep the body for composite statements."""
    BODY[key] = body.strip()
    ORACLE[key] = PREFIX + "SELECT * FROM (\n" + body.strip() + "\n) AS q\n"


def sub(key: str) -> str:
    return "(" + BODY[key] + ")"


def half_up(num: str, den: str, mult: int = 10000, div: str = "100.0") -> str:
    """Half-up rounding of num/den*(mult/div) for non-negative num; 0.0 when den = 0."""
    return (f"(CASE WHEN ({den}) > 0 THEN floor((CAST({num} AS DOUBLE) * {2 * mult} + ({den})) / (2 * ({den}))) / {div} "
            f"ELSE CAST(0.0 AS DOUBLE) END)")


def signed_half_up(num: str, den: str) -> str:
    return (f"(CASE WHEN ({den}) > 0 THEN sign({num}) * floor((abs(CAST({num} AS DOUBLE)) * 20000 + ({den})) / (2 * ({den}))) / 100.0 "
            f"ELSE CAST(0.0 AS DOUBLE) END)")


def tenths(num: str, den: str) -> str:
    u = f"CAST(floor((abs(CAST({num} AS DOUBLE)) * 2000 + ({den})) / (2 * ({den}))) AS BIGINT)"
    return f"concat(CAST({u} // 10 AS VARCHAR), '.', CAST({u} % 10 AS VARCHAR))"


def numtxt(x: str) -> str:
    """Python ``str()`` of a float with at most two decimals."""
    cents = f"CAST(floor(abs({x}) * 100 + 0.5) AS BIGINT)"
    frac = f"({cents} % 100)"
    frac_txt = (f"CASE WHEN {frac} = 0 THEN '0' WHEN {frac} % 10 = 0 THEN CAST({frac} // 10 AS VARCHAR) "
                f"WHEN {frac} < 10 THEN concat('0', CAST({frac} AS VARCHAR)) ELSE CAST({frac} AS VARCHAR) END")
    return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, CAST({cents} // 100 AS VARCHAR), '.', {frac_txt})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TXT = "lower(concat(coalesce(title, ''), ' ', coalesce(summary, '')))"


def any_in(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def count_in(text: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def code(col: str, valid: str) -> str:
    v = f"trim(replace({col}, '.0', ''))"
    return f"(CASE WHEN {v} IN ({valid}) THEN {v} END)"


from .. import params as P  # noqa: E402

SEARCH_ANY = any_in(TXT, sorted({t.lower() for t in P.SEARCH_TERMS}))
RELEVANCE = count_in(TXT, P.RELEVANCE_KEYWORDS)
VACC_ANY = "(DOSE_1_COV IS NOT NULL OR DOSE_2_COV IS NOT NULL OR DOSE_REF IS NOT NULL OR DOSE_2REF IS NOT NULL OR DOSE_ADIC IS NOT NULL)"
CPF, PHONE, EMAIL = q(P.CPF_PATTERN), q(P.PHONE_PATTERN), q(P.EMAIL_PATTERN)


def redact_sql(x: str) -> str:
    out = x
    for pat, rep in ((CPF, P.CPF_REPLACEMENT), (PHONE, P.PHONE_REPLACEMENT), (EMAIL, P.EMAIL_REPLACEMENT)):
        out = f"regexp_replace({out}, {pat}, {q(rep)}, 'g')"
    return out


REF_CTE = f"""ref AS (SELECT CASE WHEN max(DT_NOTIFIC) < {AS_OF} - 1095 THEN max(DT_NOTIFIC) ELSE {AS_OF} END AS r,
                     count(DT_NOTIFIC) AS total_records FROM cases)"""


def in_win(lo: int, hi: int = 0) -> str:
    return f"DT_NOTIFIC BETWEEN r - {lo} AND r - {hi}"


BUNDLE = f"""
WITH {REF_CTE},
win AS (
  SELECT r, total_records,
    count(*) FILTER (WHERE {in_win(30)}) AS g_cur,
    count(*) FILTER (WHERE {in_win(60, 30)}) AS g_prev,
    count(*) FILTER (WHERE {in_win(90)}) AS m_total,
    count(*) FILTER (WHERE {in_win(90)} AND EVOLUCAO IN ('2', '3')) AS m_deaths,
    count(*) FILTER (WHERE {in_win(30)}) AS i_total,
    count(*) FILTER (WHERE {in_win(30)} AND UTI = '1') AS i_icu,
    count(*) FILTER (WHERE {in_win(90)}) AS v_total,
    count(*) FILTER (WHERE {in_win(90)} AND {VACC_ANY}) AS v_vacc
  FROM cases, ref GROUP BY r, total_records)
SELECT 'case_increase_rate' AS metric, 30 AS period_days, r AS reference_date, g_cur - g_prev AS numerator,
       g_prev AS denominator,
       CASE WHEN g_prev = 0 THEN CASE WHEN g_cur = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(100.0 AS DOUBLE) END
            ELSE {signed_half_up('g_cur - g_prev', 'g_prev')} END AS rate, total_records FROM win
UNION ALL SELECT 'mortality_rate', 90, r, m_deaths, m_total, {half_up('m_deaths', 'm_total')}, total_records FROM win
UNION ALL SELECT 'icu_occupancy_rate', 30, r, i_icu, i_total, {half_up('i_icu', 'i_total')}, total_records FROM win
UNION ALL SELECT 'vaccination_rate', 90, r, v_vacc, v_total, {half_up('v_vacc', 'v_total')}, total_records FROM win
"""
register("metrics_bundle", BUNDLE)

# ===================================================================== metrics
register("case_increase_rate", f"""
WITH {REF_CTE},
w AS (SELECT r, total_records, count(*) FILTER (WHERE {in_win(30)}) AS c,
             count(*) FILTER (WHERE {in_win(60, 30)}) AS p FROM cases, ref GROUP BY r, total_records)
SELECT 'case_increase_rate' AS metric, r AS reference_date, r - 30 AS current_start, r AS current_end,
  r - 60 AS previous_start, r - 30 AS previous_end, c AS current_cases, p AS previous_cases, c - p AS absolute_change,
  CASE WHEN total_records = 0 THEN CAST(0.0 AS DOUBLE) WHEN p = 0 THEN CASE WHEN c = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(100.0 AS DOUBLE) END
       ELSE {signed_half_up('c - p', 'p')} END AS rate,
  CASE WHEN total_records = 0 THEN 'Sem dados disponíveis para o período analisado'
       WHEN p = 0 AND c = 0 THEN 'Sem casos em ambos os períodos'
       WHEN p = 0 THEN 'Novos casos identificados'
       WHEN c > p THEN concat('Aumento de ', {tenths('c - p', 'p')}, '% em relação ao período anterior')
       WHEN c < p THEN concat('Diminuição de ', {tenths('c - p', 'p')}, '% em relação ao período anterior')
       ELSE 'Número de casos estável' END AS interpretation
FROM w
""")

register("case_increase_presets", f"""
WITH {REF_CTE},
w AS (""" + " UNION ALL ".join(f"""
  SELECT '{name}' AS preset, {days} AS period_days, r, total_records, count(*) FILTER (WHERE {in_win(days)}) AS c,
    count(*) FILTER (WHERE {in_win(2 * days, days)}) AS p FROM cases, ref GROUP BY r, total_records""" for name, days in (("weekly", 7), ("monthly", 30), ("quarterly", 90))) + f""")
SELECT preset, period_days, r AS reference_date, c AS current_cases, p AS previous_cases, c - p AS absolute_change,
  CASE WHEN total_records = 0 THEN CAST(0.0 AS DOUBLE) WHEN p = 0 THEN CASE WHEN c = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(100.0 AS DOUBLE) END
       ELSE {signed_half_up('c - p', 'p')} END AS rate
FROM w
""")


def _rate_metric(key: str, metric: str, days: int, num_name: str, den_name: str, cond: str, extra_cols: str,
                 empty: str, zero: str, bands, last: str, suffix: str = "") -> None:
    t = tenths(num_name, den_name)
    band_sql = "".join(f" WHEN {num_name} * 100.0 < {den_name} * {lim} THEN concat({q(lbl)}, {t}, '%{suffix}')" for lim, lbl in bands)
    register(key, f"""
WITH {REF_CTE},
w AS (SELECT r, count(*) FILTER (WHERE {in_win(days)}) AS {den_name},
             count(*) FILTER (WHERE {in_win(days)} AND {cond}) AS {num_name} FROM cases, ref GROUP BY r)
SELECT {q(metric)} AS metric, r AS reference_date, r - {days} AS start_date, r AS end_date,
  {extra_cols},
  {half_up(num_name, den_name)} AS rate,
  CASE WHEN {den_name} = 0 THEN {q(empty)} WHEN {num_name} = 0 THEN {q(zero)}{band_sql}
       ELSE concat({q(last)}, {t}, '%{suffix}') END AS interpretation
FROM w
""")


_rate_metric("mortality_rate", "mortality_rate", 90, "deaths", "total_cases", "EVOLUCAO IN ('2', '3')",
             "total_cases, deaths, CASE WHEN total_cases = 0 THEN NULL ELSE " + half_up("total_cases - deaths", "total_cases") + " END AS survival_rate",
             "Sem dados para o período analisado", "Nenhum óbito registrado no período",
             [(5, "Taxa de mortalidade baixa: "), (15, "Taxa de mortalidade moderada: ")], "Taxa de mortalidade alta: ")
_rate_metric("icu_rate", "icu_occupancy_rate", 30, "icu_cases", "total_hospitalized", "UTI = '1'",
             "total_hospitalized, icu_cases, total_hospitalized - icu_cases AS non_icu_cases",
             "Sem dados para o período analisado", "Nenhuma internação em UTI registrada",
             [(20, "Taxa de UTI baixa: "), (40, "Taxa de UTI moderada: ")], "Taxa de UTI alta: ", " - casos graves")
_rate_metric("vaccination_rate", "vaccination_rate", 90, "vaccinated_cases", "total_cases", VACC_ANY,
             "total_cases, vaccinated_cases, total_cases - vaccinated_cases AS unvaccinated_cases",
             "Dados de vacinação não disponíveis para o período", "Nenhum caso vacinado identificado no período",
             [(30, "Taxa de vacinação baixa: "), (70, "Taxa de vacinação moderada: ")], "Taxa de vacinação alta: ")

register("dose_breakdown", f"""
WITH {REF_CTE}
SELECT d.dose, d.cases FROM (
  SELECT 0 AS pos, 'dose_1' AS dose, count(DOSE_1_COV) FILTER (WHERE {in_win(90)}) AS cases FROM cases, ref
  UNION ALL SELECT 1, 'dose_2', count(DOSE_2_COV) FILTER (WHERE {in_win(90)}) FROM cases, ref
  UNION ALL SELECT 2, 'dose_booster', count(DOSE_REF) FILTER (WHERE {in_win(90)}) FROM cases, ref
  UNION ALL SELECT 3, 'dose_2nd_booster', count(DOSE_2REF) FILTER (WHERE {in_win(90)}) FROM cases, ref
  UNION ALL SELECT 4, 'dose_additional', count(DOSE_ADIC) FILTER (WHERE {in_win(90)}) FROM cases, ref) d
""")

register("adjust_reference_date", f"""
WITH m AS (SELECT max(DT_NOTIFIC) AS max_date FROM cases)
SELECT max_date, {AS_OF} AS requested_date,
  CASE WHEN max_date < DATE '2005-01-01' - 1095 THEN max_date ELSE {AS_OF} END AS reference_date,
  (CASE WHEN max_date < DATE '2005-01-01' - 1095 THEN max_date ELSE {AS_OF} END) <> {AS_OF} AS adjusted
FROM m
""")

register("metric_bands", f"""
SELECT metric, rate,
  CASE WHEN metric = 'case_increase_rate' AND denominator = 0 THEN CASE WHEN numerator = 0 THEN 'zero' ELSE 'new' END
       WHEN metric = 'case_increase_rate' THEN CASE WHEN numerator > 0 THEN 'increase' WHEN numerator < 0 THEN 'decrease' ELSE 'stable' END
       WHEN denominator = 0 THEN 'no_data' WHEN numerator = 0 THEN 'zero'
       WHEN metric = 'mortality_rate' AND numerator * 100 < denominator * 5 THEN 'low'
       WHEN metric = 'mortality_rate' AND numerator * 100 < denominator * 15 THEN 'moderate'
       WHEN metric = 'icu_occupancy_rate' AND numerator * 100 < denominator * 20 THEN 'low'
       WHEN metric = 'icu_occupancy_rate' AND numerator * 100 < denominator * 40 THEN 'moderate'
       WHEN metric = 'vaccination_rate' AND numerator * 100 < denominator * 30 THEN 'low'
       WHEN metric = 'vaccination_rate' AND numerator * 100 < denominator * 70 THEN 'moderate'
       ELSE 'high' END AS band,
  CASE WHEN denominator = 0 THEN NULL ELSE {tenths('numerator', 'denominator')} END AS rate_text
FROM {sub('metrics_bundle')} b
""")

_LIMITS = ", ".join(f"({q(m)}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), CAST({w} AS DOUBLE))" for m, lo, hi, w in P.METRIC_LIMITS)
register("metric_limits", f"""
WITH limits(metric, min_value, max_value, warning_threshold) AS (VALUES {_LIMITS}),
j AS (SELECT b.metric, b.rate, l.min_value, l.max_value, l.warning_threshold FROM {sub('metrics_bundle')} b LEFT JOIN limits l ON b.metric = l.metric),
s AS (SELECT *, CASE WHEN min_value IS NULL THEN NULL WHEN rate < min_value THEN 'below_min' WHEN rate > max_value THEN 'above_max'
                     WHEN rate > warning_threshold THEN 'above_warning' END AS status FROM j)
SELECT metric, coalesce(rate, CAST(0.0 AS DOUBLE)) AS rate, min_value, max_value, warning_threshold, status,
  CASE WHEN rate IS NULL THEN concat(metric, ': valor inválido (nan)')
       WHEN status = 'below_min' THEN concat(metric, ': valor abaixo do mínimo (', {numtxt('rate')}, ' < ', {numtxt('min_value')}, ')')
       WHEN status = 'above_max' THEN concat(metric, ': valor acima do máximo (', {numtxt('rate')}, ' > ', {numtxt('max_value')}, ')')
       WHEN status = 'above_warning' THEN concat(metric, ': valor alto, requer atenção (', {numtxt('rate')}, '%)') END AS warning,
  CASE WHEN rate IS NULL THEN 'Valor indisponível devido a erro de cálculo' END AS override_interpretation
FROM s
""")

_VAL = ", ".join(f"({q(m)}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for m, lo, hi in P.VALIDATION_LIMITS)
register("metric_alerts", f"""
WITH v(metric, min_value, max_value) AS (VALUES {_VAL}),
j AS (SELECT b.metric, b.rate, v.min_value, v.max_value FROM {sub('metrics_bundle')} b LEFT JOIN v ON b.metric = v.metric)
SELECT metric, rate,
  CASE WHEN metric = 'vaccination_rate' THEN CASE WHEN rate < 50 THEN 'low' WHEN rate > 80 THEN 'good' ELSE 'adequate' END
       WHEN metric = 'case_increase_rate' THEN CASE WHEN rate > 100 THEN 'critical' WHEN rate > 50 THEN 'warning' ELSE 'normal' END
       WHEN metric = 'mortality_rate' THEN CASE WHEN rate > 25 THEN 'critical' WHEN rate > 15 THEN 'warning' ELSE 'normal' END
       WHEN metric = 'icu_occupancy_rate' THEN CASE WHEN rate > 80 THEN 'critical' WHEN rate > 60 THEN 'warning' ELSE 'normal' END
  END AS alert_level,
  NOT (rate < min_value OR rate > max_value) AS valid,
  CASE WHEN rate < min_value THEN concat('Valor ', {numtxt('rate')}, ' abaixo do mínimo ', {numtxt('min_value')})
       WHEN rate > max_value THEN concat('Valor ', {numtxt('rate')}, ' acima do máximo ', {numtxt('max_value')})
       ELSE 'Valor dentro dos limites' END AS message
FROM j
""")

register("rates_by_state", f"""
WITH s AS (
  SELECT SG_UF_NOT,
    count(*) FILTER (WHERE DT_NOTIFIC BETWEEN {AS_OF} - 90 AND {AS_OF}) AS cases_mortality_window,
    count(*) FILTER (WHERE DT_NOTIFIC BETWEEN {AS_OF} - 90 AND {AS_OF} AND TEVE_OBITO = 1) AS deaths,
    count(*) FILTER (WHERE DT_NOTIFIC BETWEEN {AS_OF} - 30 AND {AS_OF}) AS cases_icu_window,
    count(*) FILTER (WHERE DT_NOTIFIC BETWEEN {AS_OF} - 30 AND {AS_OF} AND TEVE_UTI = 1) AS icu_cases,
    count(*) FILTER (WHERE DT_NOTIFIC BETWEEN {AS_OF} - 90 AND {AS_OF}) AS cases_vaccination_window,
    count(*) FILTER (WHERE DT_NOTIFIC BETWEEN {AS_OF} - 90 AND {AS_OF} AND {VACC_ANY}) AS vaccinated_cases
  FROM cases WHERE DT_NOTIFIC BETWEEN {AS_OF} - 90 AND {AS_OF} GROUP BY SG_UF_NOT)
SELECT *, {half_up('deaths', 'cases_mortality_window')} AS mortality_rate,
  {half_up('icu_cases', 'cases_icu_window')} AS icu_rate,
  {half_up('vaccinated_cases', 'cases_vaccination_window')} AS vaccination_rate
FROM s
""")

# ===================================================================== sources
ESSENTIAL_PRESENT = ["DT_NOTIFIC", "SG_UF_NOT", "CO_MUN_NOT", "CS_SEXO", "NU_IDADE_N", "UTI", "EVOLUCAO", "DT_EVOLUCA",
                     "HOSPITAL", "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "FEBRE", "TOSSE", "DISPNEIA", "DESC_RESP",
                     "DIARREIA", "VOMITO"]
register("src_project", f"SELECT {', '.join(ESSENTIAL_PRESENT)} FROM raw_cases")
_NOTE = """CASE WHEN CAST(NU_NOTIFIC AS BIGINT) % 997 = 0 THEN 'linha 1' || chr(10) || chr(10) || 'linha "2"; fim'
  WHEN CAST(NU_NOTIFIC AS BIGINT) % 991 = 0 THEN 'a;b' WHEN CAST(NU_NOTIFIC AS BIGINT) % 983 = 0 THEN 'dito ""isto""' END AS OBS_NOTA"""
register("src_csv_scan", f"SELECT *, {_NOTE} FROM raw_cases")
register("load_window", f"SELECT *, {_NOTE} FROM typed WHERE DT_NOTIFIC BETWEEN DATE '2000-06-01' AND DATE '2001-06-01'")
register("load_with_fallback", """
WITH probe AS (SELECT count(*) FILTER (WHERE DT_NOTIFIC BETWEEN DATE '1994-06-01' - 365 AND DATE '1994-06-01') AS n FROM typed)
SELECT t.*, CASE WHEN n > 0 THEN 'recent' ELSE 'historical' END AS mode
FROM typed t, probe
WHERE DT_NOTIFIC IS NOT NULL
  AND CASE WHEN n > 0 THEN DT_NOTIFIC BETWEEN DATE '1994-06-01' - 365 AND DATE '1994-06-01'
           ELSE DT_NOTIFIC BETWEEN DATE '2000-01-01' AND DATE '2001-06-01' END
""")
_ACOLS = "article_id, title, summary, link, published, source, source_type"
register("articles_union", f"""
SELECT {_ACOLS} FROM articles WHERE source_type = 'rss'
UNION ALL
SELECT {_ACOLS} FROM articles WHERE source_type = 'news_api' AND title IS NOT NULL AND title <> ''
""")
register("articles_fallback", f"""
SELECT {_ACOLS}, CAST(NULL AS INTEGER) AS relevance_score
FROM articles WHERE source_type = 'news_api' AND title IS NOT NULL AND title <> ''
""")
register("articles_bad_lines", """
SELECT t.source_type, count(article_id) AS bad_lines FROM (VALUES ('rss'), ('news_api')) AS t(source_type)
LEFT JOIN articles ON articles.source_type = t.source_type AND article_id % 97 = 0 GROUP BY 1
""")
register("sink_parquet_roundtrip", "SELECT * FROM cases")
register("sink_replace_months", "SELECT * FROM cases")

# ===================================================================== cleaning
register("parse_dates", "SELECT NU_NOTIFIC, DT_NOTIFIC, DT_EVOLUCA, DOSE_1_COV, DOSE_2_COV, DOSE_REF, DOSE_2REF, DOSE_ADIC FROM typed")
register("clean_codes", "SELECT NU_NOTIFIC, CS_SEXO, UTI, HOSPITAL, EVOLUCAO FROM typed")
register("clean_age", "SELECT NU_NOTIFIC, NU_IDADE_N FROM typed")
register("clean_symptoms", "SELECT NU_NOTIFIC, FEBRE, TOSSE, DISPNEIA, DESC_RESP, DIARREIA, VOMITO FROM typed")
register("age_band", "SELECT NU_NOTIFIC, NU_IDADE_N, FAIXA_ETARIA FROM cases")
register("outcome_label", "SELECT NU_NOTIFIC, EVOLUCAO, EVOLUCAO_SIMPLES FROM cases")
register("icu_flag", "SELECT NU_NOTIFIC, UTI, CASO_GRAVE, TEVE_UTI FROM cases")
register("death_flag", "SELECT NU_NOTIFIC, EVOLUCAO, TEVE_OBITO FROM cases")
register("vaccination_status", "SELECT NU_NOTIFIC, DOSE_1_COV, STATUS_VACINAL_COVID FROM cases")
register("symptom_count", "SELECT NU_NOTIFIC, NUM_SINTOMAS FROM cases")
register("calendar_fields", "SELECT NU_NOTIFIC, DT_NOTIFIC, ANO, MES, SEMANA_EPI, CAST(isoyear(DT_NOTIFIC) AS INTEGER) AS ANO_SEMANA_EPI FROM cases")
register("age_risk", "SELECT NU_NOTIFIC, NU_IDADE_N, GRUPO_RISCO_IDADE FROM cases")
register("decode_codes", """
SELECT NU_NOTIFIC,
  CASE CS_SEXO WHEN 'M' THEN 'Masculino' WHEN 'F' THEN 'Feminino' WHEN 'I' THEN 'Ignorado' END AS CS_SEXO_DESC,
  CASE UTI WHEN '1' THEN 'Sim' WHEN '2' THEN 'Não' WHEN '9' THEN 'Ignorado' END AS UTI_DESC,
  CASE EVOLUCAO WHEN '1' THEN 'Cura' WHEN '2' THEN 'Óbito por SRAG' WHEN '3' THEN 'Óbito por outras causas' WHEN '9' THEN 'Ignorado' END AS EVOLUCAO_DESC
FROM cases
""")
register("age_from_birth", f"SELECT NU_NOTIFIC, DT_NOTIFIC, CAST(floor(datediff('day', DT_NOTIFIC, {AS_OF}) / 365) AS BIGINT) AS IDADE_CALCULADA FROM cases")
register("age_band_anonymised", """
WITH a AS (SELECT CAST(trunc(NU_IDADE_N / 5) * 5 AS DOUBLE) AS a FROM cases)
SELECT CASE WHEN a >= 0 AND a <= 12 THEN 'Criança' WHEN a > 12 AND a <= 18 THEN 'Adolescente'
            WHEN a > 18 AND a <= 60 THEN 'Adulto' WHEN a > 60 AND a <= 120 THEN 'Idoso' END AS FAIXA_ETARIA,
       CASE WHEN a >= 60 OR a < 2 THEN 'Alto' ELSE 'Baixo' END AS GRUPO_RISCO_IDADE,
       count(*) AS cases
FROM a GROUP BY ALL
""")

# ===================================================================== filters
register("filter_date_range", f"SELECT NU_NOTIFIC, DT_NOTIFIC, EVOLUCAO FROM cases WHERE DT_NOTIFIC BETWEEN DATE '2001-03-03' AND {AS_OF}")
register("require_date", "SELECT NU_NOTIFIC, DT_NOTIFIC FROM typed WHERE DT_NOTIFIC IS NOT NULL")
register("filter_temporal_order", "SELECT NU_NOTIFIC, DT_NOTIFIC, DT_EVOLUCA FROM cases WHERE DT_EVOLUCA IS NULL OR DT_EVOLUCA >= DT_NOTIFIC")
register("drop_all_null", "SELECT NU_NOTIFIC, DT_NOTIFIC, SG_UF_NOT FROM cases WHERE DT_NOTIFIC IS NOT NULL OR SG_UF_NOT IS NOT NULL")
register("filter_plausible_date", f"SELECT NU_NOTIFIC, DT_NOTIFIC FROM cases WHERE DT_NOTIFIC IS NULL OR DT_NOTIFIC BETWEEN DATE '2000-01-01' AND {AS_OF}")
register("filter_plausible_age", """
SELECT NU_NOTIFIC, TRY_CAST(NU_IDADE_N AS DOUBLE) AS NU_IDADE_N FROM raw_cases
WHERE TRY_CAST(NU_IDADE_N AS DOUBLE) IS NULL OR TRY_CAST(NU_IDADE_N AS DOUBLE) BETWEEN 0 AND 120
""")

# ===================================================================== series
DAILY_FILL = f"""
WITH cal AS (SELECT CAST(d AS DATE) AS "date" FROM generate_series(TIMESTAMP '2001-05-02', TIMESTAMP '2001-06-01', INTERVAL 1 DAY) t(d)),
daily AS (SELECT DT_NOTIFIC AS "date", count(*) AS n FROM cases WHERE DT_NOTIFIC BETWEEN {AS_OF} - 30 AND {AS_OF} GROUP BY 1)
SELECT cal."date", CAST(coalesce(daily.n, 0) AS BIGINT) AS cases FROM cal LEFT JOIN daily ON cal."date" = daily."date"
"""
register("daily_calendar_fill", DAILY_FILL)
register("daily_counts", f'SELECT DT_NOTIFIC AS "date", count(*) AS cases FROM cases WHERE DT_NOTIFIC BETWEEN {AS_OF} - 30 AND {AS_OF} GROUP BY 1')


def _monthly(as_of: str) -> str:
    return f"""
WITH st AS (SELECT count(*) FILTER (WHERE DT_NOTIFIC BETWEEN {as_of} - 365 AND {as_of}) AS recent, max(DT_NOTIFIC) AS mx FROM cases),
picked AS (SELECT DT_NOTIFIC FROM cases, st WHERE DT_NOTIFIC IS NOT NULL AND
           CASE WHEN recent > 0 THEN DT_NOTIFIC BETWEEN {as_of} - 365 AND {as_of} ELSE DT_NOTIFIC >= mx - 365 END)
SELECT CAST(year(DT_NOTIFIC) AS INTEGER) AS year, CAST(month(DT_NOTIFIC) AS INTEGER) AS month, count(*) AS cases,
       CAST(date_trunc('month', DT_NOTIFIC) AS DATE) AS month_start
FROM picked GROUP BY ALL
"""


register("monthly_counts", _monthly(AS_OF))
register("monthly_counts_fallback", _monthly("DATE '2005-06-01'"))
register("moving_average_7d", f"""
SELECT "date", cases, CASE WHEN count(*) OVER w = 7 THEN CAST(sum(cases) OVER w AS DOUBLE) / 7.0 END AS moving_average_7d
FROM {sub('daily_calendar_fill')} f
WINDOW w AS (ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")


def _series_summary(src: str, key: str) -> str:
    return f"""
SELECT CAST(sum(cases) AS BIGINT) AS total_cases, {half_up('sum(cases)', 'count(*)', 10, '10.0')} AS avg_cases,
  CAST(max(cases) AS BIGINT) AS peak_cases,
  min({key}) FILTER (WHERE cases = (SELECT max(cases) FROM {src} x)) AS peak_{key.strip('"')},
  count(*) AS points
FROM {src} s
"""


register("daily_series_summary", _series_summary(sub("daily_calendar_fill"), '"date"'))
register("monthly_series_summary", _series_summary(sub("monthly_counts"), "month_start"))

# ===================================================================== profile
register("value_counts_outcome", "SELECT EVOLUCAO, count(*) AS count FROM cases GROUP BY EVOLUCAO")
register("top_states", "SELECT SG_UF_NOT, count(*) AS count FROM cases WHERE SG_UF_NOT IS NOT NULL GROUP BY 1 ORDER BY count DESC, SG_UF_NOT LIMIT 5")
register("vaccination_distribution", "SELECT STATUS_VACINAL_COVID, count(*) AS count FROM cases GROUP BY 1")
register("completeness", "\nUNION ALL\n".join(
    f"SELECT {q(c)} AS \"column\", count({c}) AS non_null_count, {half_up(f'count({c})', 'count(*)')} AS completeness_percent FROM cases"
    for c in ESSENTIAL_PRESENT))
register("age_summary", f"""
SELECT count(NU_IDADE_N) AS n, {half_up('sum(NU_IDADE_N)', 'count(NU_IDADE_N)', 10, '10.0')} AS mean,
  floor(median(NU_IDADE_N) * 10 + 0.5) / 10.0 AS median,
  CAST(trunc(min(NU_IDADE_N)) AS BIGINT) AS min, CAST(trunc(max(NU_IDADE_N)) AS BIGINT) AS max
FROM cases
""")
register("age_ranges", """
SELECT count(*) FILTER (WHERE NU_IDADE_N < 18) AS age_0_17,
       count(*) FILTER (WHERE NU_IDADE_N >= 18 AND NU_IDADE_N < 60) AS age_18_59,
       count(*) FILTER (WHERE NU_IDADE_N >= 60) AS age_60_plus
FROM cases
""")
register("date_span", "SELECT min(DT_NOTIFIC) AS start, max(DT_NOTIFIC) AS \"end\", CAST(datediff('day', min(DT_NOTIFIC), max(DT_NOTIFIC)) AS INTEGER) AS total_days FROM cases")
register("severity_indicators", """
SELECT 'uti_cases' AS indicator, CAST(NULL AS VARCHAR) AS code, count(*) FILTER (WHERE UTI = '1') AS count FROM cases
UNION ALL
SELECT 'evolution', EVOLUCAO, count(*) FROM cases WHERE EVOLUCAO IS NOT NULL GROUP BY EVOLUCAO
""")
_comp_rows = "\n".join(f"UNION ALL SELECT 'completeness', {q(c)}, {half_up(f'c_{c}', 'n')}, NULL FROM st" for c in ESSENTIAL_PRESENT)
register("data_summary", f"""
WITH st AS (SELECT count(*) AS n, min(DT_NOTIFIC) AS s, max(DT_NOTIFIC) AS e, count(NU_IDADE_N) AS an,
                   sum(NU_IDADE_N) AS asum, median(NU_IDADE_N) AS amed, min(NU_IDADE_N) AS amin, max(NU_IDADE_N) AS amax,
                   {', '.join(f'count({c}) AS c_{c}' for c in ESSENTIAL_PRESENT)} FROM cases)
SELECT 'total_records' AS section, CAST(NULL AS VARCHAR) AS item, CAST(n AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text_value FROM st
UNION ALL SELECT 'date_range', 'start', NULL, CAST(s AS VARCHAR) FROM st
UNION ALL SELECT 'date_range', 'end', NULL, CAST(e AS VARCHAR) FROM st
UNION ALL SELECT 'date_range', 'total_days', datediff('day', s, e), NULL FROM st
{_comp_rows}
UNION ALL SELECT 'age', 'mean', CASE WHEN an > 0 THEN {half_up('asum', 'an', 10, '10.0')} END, NULL FROM st
UNION ALL SELECT 'age', 'median', CASE WHEN an > 0 THEN floor(amed * 10 + 0.5) / 10.0 END, NULL FROM st
UNION ALL SELECT 'age', 'min', floor(amin), NULL FROM st
UNION ALL SELECT 'age', 'max', floor(amax), NULL FROM st
UNION ALL SELECT 'evolution', EVOLUCAO, count(*), NULL FROM cases WHERE EVOLUCAO IS NOT NULL GROUP BY EVOLUCAO
UNION ALL SELECT 'vaccination_status', STATUS_VACINAL_COVID, count(*), NULL FROM cases WHERE STATUS_VACINAL_COVID IS NOT NULL GROUP BY STATUS_VACINAL_COVID
UNION ALL SELECT * FROM (SELECT 'top_states', SG_UF_NOT, count(*) AS c, NULL FROM cases WHERE SG_UF_NOT IS NOT NULL
                         GROUP BY SG_UF_NOT ORDER BY c DESC, SG_UF_NOT LIMIT 5)
""")
_REST = ["NU_NOTIFIC", "SG_UF_NOT", "UTI", "HOSPITAL", "EVOLUCAO", "DT_EVOLUCA", "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF",
         "DOSE_2REF", "DOSE_ADIC", "FEBRE", "TOSSE", "DISPNEIA", "DESC_RESP", "DIARREIA", "VOMITO"]
register("dedupe_cases", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY DT_NOTIFIC, CO_MUN_NOT, NU_IDADE_N, CS_SEXO
                               ORDER BY {', '.join(c + ' ASC NULLS FIRST' for c in _REST)}) AS rn
  FROM cases) WHERE rn = 1
""")


def _dups(src: str) -> str:
    return f"""
WITH t AS (SELECT count(*) AS total FROM {src}),
f AS (SELECT count(*) AS g FROM (SELECT DISTINCT * FROM {src})),
k AS (SELECT count(*) AS g FROM (SELECT DISTINCT DT_NOTIFIC, SG_UF_NOT, NU_IDADE_N, CS_SEXO FROM {src}))
SELECT total AS total_records, total - f.g AS complete_duplicates, total - k.g AS key_field_duplicates,
  'DT_NOTIFIC,SG_UF_NOT,NU_IDADE_N,CS_SEXO' AS key_fields_used, k.g AS unique_records
FROM t, f, k
"""


register("duplicate_counts", _dups("cases"))

# ===================================================================== quality (on raw_cases)
RAW_COLS = ["NU_NOTIFIC", "DT_NOTIFIC", "SG_UF_NOT", "CO_MUN_NOT", "CS_SEXO", "NU_IDADE_N", "UTI", "HOSPITAL", "EVOLUCAO",
            "DT_EVOLUCA", "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC", "FEBRE", "TOSSE", "DISPNEIA",
            "DESC_RESP", "DIARREIA", "VOMITO"]

register("q_required", "\nUNION ALL\n".join(f"""
SELECT {q(f)} AS field, true AS present, count(*) FILTER (WHERE {f} IS NULL) AS null_count,
  {half_up(f'count(*) FILTER (WHERE {f} IS NULL)', 'count(*)')} AS null_percentage,
  count(*) FILTER (WHERE {f} IS NULL) = 0 AS complete,
  CASE WHEN count(*) FILTER (WHERE {f} IS NULL) > 0 THEN 'error' END AS severity,
  CASE WHEN count(*) FILTER (WHERE {f} IS NULL) > 0 THEN concat('Campo obrigatório ''{f}'' tem ',
       {tenths(f'count(*) FILTER (WHERE {f} IS NULL)', 'count(*)')}, '% valores nulos') END AS message
FROM raw_cases""" for f in P.REQUIRED_FIELDS))

register("q_null_profile", "\nUNION ALL\n".join(f"""
SELECT {q(c)} AS field, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  {half_up(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')} AS null_percentage,
  CASE WHEN count(*) FILTER (WHERE {c} IS NULL) * 100 > count(*) * 50.0 THEN 'warning' END AS severity,
  CASE WHEN count(*) FILTER (WHERE {c} IS NULL) * 100 > count(*) * 50.0 THEN concat('Campo ''{c}'' tem alta taxa de nulos: ',
       {tenths(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')}, '%') END AS message
FROM raw_cases""" for c in RAW_COLS))


def _type_row(f: str, kind: str, bad_cond: str, ok: str, bad: str, msg: str) -> str:
    n = f"count(*) FILTER (WHERE {f} IS NOT NULL AND {bad_cond})"
    return (f"SELECT {q(f)} AS field, {q(kind)} AS kind, {n} AS invalid_count, "
            f"CASE WHEN {n} > 0 THEN {q(bad)} ELSE {q(ok)} END AS status, "
            f"CASE WHEN {n} > 0 THEN 'warning' END AS severity, CASE WHEN {n} > 0 THEN {q(msg)} END AS message FROM raw_cases")


register("q_types", "\nUNION ALL\n".join([
    _type_row("DT_NOTIFIC", "date", "try_strptime(DT_NOTIFIC, '%Y-%m-%d') IS NULL", "convertible_to_date", "invalid_date_format",
              "Campo de data 'DT_NOTIFIC' não está em formato válido"),
    _type_row("DT_EVOLUCA", "date", "try_strptime(DT_EVOLUCA, '%Y-%m-%d') IS NULL", "convertible_to_date", "invalid_date_format",
              "Campo de data 'DT_EVOLUCA' não está em formato válido"),
    _type_row("NU_IDADE_N", "numeric", "TRY_CAST(NU_IDADE_N AS DOUBLE) IS NULL", "convertible_to_numeric", "invalid_numeric",
              "Campo numérico 'NU_IDADE_N' contém valores não numéricos"),
]))

_AGE = "TRY_CAST(NU_IDADE_N AS DOUBLE)"
register("q_ranges", f"""
SELECT 'NU_IDADE_N' AS field, 'min' AS side, CAST(0 AS DOUBLE) AS bound, count(*) FILTER (WHERE {_AGE} < 0) AS violations,
  CASE WHEN count(*) FILTER (WHERE {_AGE} < 0) > 0 THEN 'warning' END AS severity,
  CASE WHEN count(*) FILTER (WHERE {_AGE} < 0) > 0 THEN concat('Campo ''NU_IDADE_N'': ', CAST(count(*) FILTER (WHERE {_AGE} < 0) AS VARCHAR), ' valores abaixo do mínimo (0)') END AS message
FROM raw_cases
UNION ALL
SELECT 'NU_IDADE_N', 'max', CAST(120 AS DOUBLE), count(*) FILTER (WHERE {_AGE} > 120),
  CASE WHEN count(*) FILTER (WHERE {_AGE} > 120) > 0 THEN 'warning' END,
  CASE WHEN count(*) FILTER (WHERE {_AGE} > 120) > 0 THEN concat('Campo ''NU_IDADE_N'': ', CAST(count(*) FILTER (WHERE {_AGE} > 120) AS VARCHAR), ' valores acima do máximo (120)') END
FROM raw_cases
""")

_CAT = [("CS_SEXO", "'M','F','I',''"), ("EVOLUCAO", "'1','2','3','9',''"), ("UTI", "'1','2','9',''"), ("HOSPITAL", "'1','2','9',''")]
register("q_categorical", f"""
WITH v AS ({' UNION ALL '.join(f"SELECT {q(f)} AS field, upper(trim({f})) AS value, ({'upper(trim(' + f + ')) IN (' + vals + ')'}) AS ok FROM raw_cases" for f, vals in _CAT)}),
bad AS (SELECT field, value, count(*) AS n FROM v WHERE value IS NOT NULL AND NOT ok GROUP BY field, value),
top AS (SELECT field, string_agg(value, ', ' ORDER BY value) AS invalid_values
        FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) AS rn FROM bad) WHERE rn <= 10 GROUP BY field),
cnt AS (SELECT field, CAST(sum(n) AS BIGINT) AS invalid_count FROM bad GROUP BY field),
base(field) AS (VALUES {', '.join(f"({q(f)})" for f, _ in _CAT)})
SELECT base.field, coalesce(cnt.invalid_count, 0) AS invalid_count, top.invalid_values,
  CASE WHEN coalesce(cnt.invalid_count, 0) > 0 THEN 'warning' END AS severity,
  CASE WHEN coalesce(cnt.invalid_count, 0) > 0 THEN concat('Campo ''', base.field, ''': ', CAST(cnt.invalid_count AS VARCHAR), ' valores inválidos encontrados') END AS message
FROM base LEFT JOIN cnt ON base.field = cnt.field LEFT JOIN top ON base.field = top.field
""")

register("q_temporal", f"""
WITH d AS (SELECT try_strptime(DT_NOTIFIC, '%Y-%m-%d') AS a, try_strptime(DT_EVOLUCA, '%Y-%m-%d') AS b FROM raw_cases),
s AS (SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND b < a) AS x,
             count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS c FROM d)
SELECT 'DT_NOTIFIC_vs_DT_EVOLUCA' AS pair, x AS inconsistent_count, c AS total_comparable,
  CASE WHEN c > 0 THEN {half_up('c - x', 'c')} ELSE CAST(100.0 AS DOUBLE) END AS consistency_rate,
  CASE WHEN x > 0 THEN 'error' END AS severity,
  CASE WHEN x > 0 THEN concat('Inconsistência temporal: ', CAST(x AS VARCHAR), ' registros onde ''DT_EVOLUCA'' é anterior a ''DT_NOTIFIC''') END AS message
FROM s
""")


def _rule(name: str, desc: str, cond: str) -> str:
    n = f"count(*) FILTER (WHERE coalesce({cond}, false))"
    return f"""
SELECT {q(name)} AS rule, {q(desc)} AS description, {n} AS violations, {n} = 0 AS passed,
  CASE WHEN {n} > 0 THEN 'warning' END AS severity,
  CASE WHEN {n} > 0 THEN concat({q('Regra de negócio violada: ' + desc + ' (')}, CAST({n} AS VARCHAR), ' casos)') END AS message
FROM raw_cases"""


_SYM_ANY = " OR ".join(f"coalesce(TRY_CAST({s} AS DOUBLE) = 1, false)" for s in P.COUNTED_SYMPTOMS)
_D1, _D2, _DR = ("(try_strptime(DOSE_1_COV, '%d/%m/%Y') IS NOT NULL)", "(try_strptime(DOSE_2_COV, '%d/%m/%Y') IS NOT NULL)",
                 "(try_strptime(DOSE_REF, '%d/%m/%Y') IS NOT NULL)")
register("q_rule_icu", _rule("uti_requires_internment", "UTI=1 requer internação hospitalar",
                             f"{code('UTI', "'1','2','9'")} = '1' AND {code('HOSPITAL', "'1','2','9'")} = '2'"))
register("q_rule_death_symptoms", _rule("death_without_symptoms", "Óbito sem sintomas registrados",
                                        f"coalesce({code('EVOLUCAO', "'1','2','3','9'")} = '2', false) AND NOT ({_SYM_ANY})"))
register("q_rule_doses", _rule("vaccination_consistency", "Consistência nas doses de vacina",
                               f"(NOT {_D1} AND {_D2}) OR ({_DR} AND (NOT {_D1} OR NOT {_D2}))"))


def _outliers(method: str, p_lo: str, p_hi: str) -> str:
    if method == "iqr":
        bounds = "q1 - (q3 - q1) * 1.5 AS lower_bound, q3 + (q3 - q1) * 1.5 AS upper_bound"
    else:
        bounds = "q1 AS lower_bound, q3 AS upper_bound"
    return f"""
WITH nums AS (SELECT {_AGE} AS v FROM raw_cases WHERE {_AGE} IS NOT NULL),
st AS (SELECT count(*) AS n, quantile_cont(v, {p_lo}) AS q1, quantile_cont(v, {p_hi}) AS q3 FROM nums),
b AS (SELECT n, {bounds} FROM st),
o AS (SELECT v FROM nums, b WHERE v < lower_bound OR v > upper_bound),
oc AS (SELECT count(*) AS outlier_count FROM o),
sm AS (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS s FROM (SELECT v FROM o ORDER BY v LIMIT 5))
SELECT 'NU_IDADE_N' AS field, {q(method)} AS method, lower_bound, upper_bound, outlier_count,
  {half_up('outlier_count', 'n')} AS outlier_percentage, coalesce(sm.s, '') AS sample_outliers,
  CASE WHEN outlier_count * 100 > n * 5.0 THEN 'warning' END AS severity,
  CASE WHEN outlier_count * 100 > n * 5.0 THEN concat('Campo ''NU_IDADE_N'' tem alta taxa de outliers: ', {tenths('outlier_count', 'n')}, '%') END AS message
FROM b, oc, sm WHERE n > 0
"""


register("q_outliers_iqr", _outliers("iqr", "0.25", "0.75"))
register("q_outliers_percentile", _outliers("percentile", "0.01", "0.99"))
register("q_outliers_many_values", _outliers("percentile", "0.01", "0.99").replace(_AGE, "TRY_CAST(CO_MUN_NOT AS DOUBLE)").replace("NU_IDADE_N", "CO_MUN_NOT"))

register("q_duplicates_raw", _dups("raw_cases"))
_QDUP = f"""
SELECT total_records, 'complete' AS kind, complete_duplicates AS duplicates,
  CASE WHEN complete_duplicates > 0 THEN 'warning' END AS severity,
  CASE WHEN complete_duplicates > 0 THEN concat('Encontradas ', CAST(complete_duplicates AS VARCHAR), ' duplicatas completas') END AS message
FROM {sub('q_duplicates_raw')} d
UNION ALL
SELECT total_records, 'key_fields', key_field_duplicates,
  CASE WHEN key_field_duplicates > complete_duplicates THEN 'warning' END,
  CASE WHEN key_field_duplicates > complete_duplicates THEN concat('Encontradas ', CAST(key_field_duplicates AS VARCHAR), ' duplicatas baseadas em campos-chave') END
FROM {sub('q_duplicates_raw')} d
"""
BODY["q_duplicates"] = _QDUP
del ORACLE["q_duplicates_raw"]

FINDINGS = f"""
SELECT * FROM (
  SELECT 'required' AS "check", field, severity, message FROM {sub('q_required')} a
  UNION ALL SELECT 'null_profile', field, severity, message FROM {sub('q_null_profile')} b
  UNION ALL SELECT 'types', field, severity, message FROM {sub('q_types')} c
  UNION ALL SELECT 'ranges', field, severity, message FROM {sub('q_ranges')} d
  UNION ALL SELECT 'categorical', field, severity, message FROM {sub('q_categorical')} e
  UNION ALL SELECT 'temporal', pair, severity, message FROM {sub('q_temporal')} f
  UNION ALL SELECT 'business_rule', rule, severity, message FROM {sub('q_rule_icu')} g
  UNION ALL SELECT 'business_rule', rule, severity, message FROM {sub('q_rule_death_symptoms')} h
  UNION ALL SELECT 'business_rule', rule, severity, message FROM {sub('q_rule_doses')} i
  UNION ALL SELECT 'outliers', field, severity, message FROM {sub('q_outliers_iqr')} j
  UNION ALL SELECT 'duplicates', kind, severity, message FROM {sub('q_duplicates')} k
) WHERE severity IS NOT NULL
"""
register("quality_score", f"""
WITH f AS (SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM ({FINDINGS})),
req AS (SELECT count(*) AS req_n, sum(CAST(100.0 AS DOUBLE) - null_percentage) AS req_sum FROM {sub('q_required')} r WHERE present),
dup AS (SELECT total_records, duplicates AS key_dups FROM {sub('q_duplicates')} d WHERE kind = 'key_fields'),
s AS (SELECT *, CAST(100.0 AS DOUBLE) - errors * CAST(10.0 AS DOUBLE) - warnings * CAST(2.0 AS DOUBLE) AS base FROM f, req, dup),
t AS (SELECT *, CASE WHEN req_n > 0 THEN base * (req_sum / req_n / CAST(100.0 AS DOUBLE)) ELSE base END
               - CASE WHEN total_records > 0 THEN key_dups / total_records ELSE CAST(0.0 AS DOUBLE) END * CAST(20.0 AS DOUBLE) AS raw FROM s)
SELECT errors, warnings, total_records, key_dups AS key_field_duplicates,
  floor(greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), raw)) * 100 + 0.5) / 100.0 AS quality_score,
  errors = 0 AS passed
FROM t
""")
register("quality_report", f"""
SELECT "check", field, severity, message, CAST(NULL AS DOUBLE) AS value FROM ({FINDINGS})
UNION ALL SELECT 'summary', 'total_records', NULL, NULL, CAST(total_records AS DOUBLE) FROM {sub('quality_score')} s1
UNION ALL SELECT 'summary', 'errors', NULL, NULL, CAST(errors AS DOUBLE) FROM {sub('quality_score')} s2
UNION ALL SELECT 'summary', 'warnings', NULL, NULL, CAST(warnings AS DOUBLE) FROM {sub('quality_score')} s3
UNION ALL SELECT 'summary', 'quality_score', NULL, NULL, quality_score FROM {sub('quality_score')} s4
UNION ALL SELECT 'summary', 'passed', NULL, NULL, CASE WHEN passed THEN 1.0 ELSE 0.0 END FROM {sub('quality_score')} s5
""")

# ===================================================================== privacy
_TYPED_COLS = ["NU_NOTIFIC", "DT_NOTIFIC", "SG_UF_NOT", "CO_MUN_NOT", "CS_SEXO", "NU_IDADE_N", "UTI", "HOSPITAL", "EVOLUCAO",
               "DT_EVOLUCA", "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC", "FEBRE", "TOSSE", "DISPNEIA",
               "DESC_RESP", "DIARREIA", "VOMITO"]
_ANON_BAND = ("CASE WHEN NU_IDADE_N >= 0 AND NU_IDADE_N <= 12 THEN '0-12' WHEN NU_IDADE_N > 12 AND NU_IDADE_N <= 18 THEN '13-18' "
              "WHEN NU_IDADE_N > 18 AND NU_IDADE_N <= 60 THEN '19-60' WHEN NU_IDADE_N > 60 AND NU_IDADE_N <= 120 THEN '60+' END")
_ANON_AGE = "CAST(trunc(NU_IDADE_N / 5) * 5 AS DOUBLE)"
register("anonymise_columns", "SELECT * EXCLUDE (NU_NOTIFIC) FROM cases")
register("anonymise_age", f"SELECT NU_NOTIFIC, {_ANON_AGE} AS NU_IDADE_N, {_ANON_BAND} AS FAIXA_ETARIA FROM typed")
register("anonymise_cases", f"SELECT * EXCLUDE (NU_NOTIFIC, CO_MUN_NOT, NU_IDADE_N), {_ANON_AGE} AS NU_IDADE_N, {_ANON_BAND} AS FAIXA_ETARIA FROM typed")
register("redact_text", f"SELECT article_id, {redact_sql('summary')} AS summary FROM articles")
_FIXED = q(P.REDACTED_FIELD_TEXT)
register("redact_frame", f"""
SELECT article_id, {_FIXED} AS nome_paciente, {redact_sql('title')} AS detalhes_title,
  {redact_sql('summary')} AS detalhes_summary, {_FIXED} AS detalhes_email_contato,
  concat_ws(' | ', {redact_sql('summary')}, {redact_sql('link')}) AS trechos,
  {_FIXED} AS mapa_cpf, {redact_sql('summary')} AS mapa_obs
FROM articles
""")
_TXT2 = "concat(lower(coalesce(title, '')), ' ', lower(coalesce(summary, '')))"
register("article_appropriate", f"""
SELECT article_id,
  CASE WHEN {any_in(_TXT2, P.PROHIBITED_TERMS)} THEN false
       WHEN {any_in("lower(coalesce(source, ''))", P.RELIABLE_SOURCES)} THEN true
       WHEN {any_in(_TXT2, P.SUSPICIOUS_TERMS)} THEN false
       ELSE true END AS appropriate
FROM articles
""")
_mask = "summary"
for _t in P.PROHIBITED_TERMS:
    _mask = f"regexp_replace({_mask}, {q('(?i)' + chr(92) + 'Q' + _t + chr(92) + 'E')}, {q(P.MASK_TEXT)}, 'g')"
register("mask_terms", f"SELECT article_id, {_mask} AS summary FROM articles")


def _rate_of(m: str) -> str:
    return f"max(CASE WHEN metric = {q(m)} THEN rate END)"


_FP_PARTS = ", ".join(["'2001-06-01'", "CAST(count(*) AS VARCHAR)", q(P.GUARDRAILS_VERSION)] + [
    f"CAST(CAST(floor({_rate_of(m)} * 100 + 0.5) AS BIGINT) AS VARCHAR)"
    for m in ("case_increase_rate", "mortality_rate", "icu_occupancy_rate", "vaccination_rate")])
register("report_fingerprint", f"""
SELECT '2001-06-01' AS report_date, count(*) AS metrics_count,
  concat('SRAG-', substr(sha256(concat_ws('|', {_FP_PARTS})), 1, 16)) AS signature
FROM {sub('metrics_bundle')} b
""")
register("pii_scan", "\nUNION ALL\n".join(f"""
SELECT {q(c)} AS "column", count(*) FILTER (WHERE regexp_matches({c}, {CPF})) AS cpf_hits,
  count(*) FILTER (WHERE regexp_matches({c}, {PHONE})) AS phone_hits,
  count(*) FILTER (WHERE regexp_matches({c}, {q(P.EMAIL_SCAN_PATTERN)})) AS email_hits FROM (
    SELECT *, concat_ws(chr(10), title, summary) AS mapa, concat_ws(chr(10), link, summary) AS detalhes FROM articles)"""
    for c in ["title", "summary", "link", "source", "source_type", "mapa", "detalhes"]))

# ===================================================================== news
register("article_recency", f"SELECT article_id, published FROM articles WHERE published IS NULL OR published >= {AS_OF} - 120")
register("article_term_filter", f"SELECT article_id, title FROM articles WHERE {SEARCH_ANY}")
register("article_relevance", f"SELECT article_id, relevance_score FROM (SELECT article_id, {RELEVANCE} AS relevance_score FROM articles) WHERE relevance_score >= 1")
register("article_rank", f"""
SELECT article_id, title, summary, relevance_score, row_number() OVER (ORDER BY relevance_score DESC, article_id) AS rank
FROM (SELECT *, {RELEVANCE} AS relevance_score FROM articles) WHERE relevance_score >= 1
""")
register("article_topk", f"""
SELECT article_id, title, relevance_score FROM (SELECT article_id, title, {RELEVANCE} AS relevance_score FROM articles)
WHERE relevance_score >= 1 ORDER BY relevance_score DESC, article_id LIMIT 10
""")
register("article_dedupe", f"""
SELECT {_ACOLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(title, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) ORDER BY article_id) AS rn
  FROM articles WHERE title IS NOT NULL AND regexp_replace(title, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') <> '') WHERE rn = 1
""")


def _theme_union(themes, cols: str, src: str = "articles") -> str:
    return " UNION ALL ".join(f"SELECT {cols}, {q(name)} AS theme FROM {src} WHERE {any_in(TXT, words)}" for name, words in themes)


register("theme_top3", f"""
SELECT article_id, title, link, theme, CAST(row_number() OVER (PARTITION BY theme ORDER BY article_id) AS INTEGER) AS position
FROM ({_theme_union(P.WIDE_THEMES, 'article_id, title, link')}) QUALIFY position <= 3
""")
register("theme_breakdown", f"SELECT theme, count(*) AS articles FROM ({_theme_union(P.ARTICLE_THEMES, 'article_id')}) GROUP BY theme")
register("theme_members", _theme_union(P.WIDE_THEMES, "article_id, title, link"))
register("theme_counts_wide", " UNION ALL ".join(
    f"SELECT {q(name)} AS theme, count(*) FILTER (WHERE {any_in(TXT, words)}) AS articles FROM articles" for name, words in P.WIDE_THEMES))
_THEMES_JOINED = "concat_ws('|', " + ", ".join(f"CASE WHEN {any_in(TXT, w)} THEN {q(n)} END" for n, w in P.ARTICLE_THEMES) + ")"
_THEMES_COUNT = "(" + " + ".join(f"CASE WHEN {any_in(TXT, w)} THEN 1 ELSE 0 END" for _, w in P.ARTICLE_THEMES) + ")"
register("article_themes", f"SELECT article_id, {_THEMES_JOINED} AS themes, {_THEMES_COUNT} AS theme_count FROM articles")
_SRC = "coalesce(source, 'Desconhecido')"
_SRC_CASE = "CASE " + " ".join(
    f"WHEN contains({'lower(' + _SRC + ')' if ins else _SRC}, {q(n)}) THEN {q(lbl)}" for n, ins, lbl in P.SOURCE_NAMES) + f" ELSE {_SRC} END"
register("source_breakdown", f"SELECT {_SRC_CASE} AS source, count(*) AS articles FROM articles GROUP BY 1")
register("article_origin_counts", "SELECT source_type, count(*) AS articles FROM articles GROUP BY 1")

_ctx_flags = []
_ctx_cols = []
_ctx_parts = []
for _cat, _words in P.CONTEXT_KEYWORDS.items():
    _names = []
    for _i, _w in enumerate(_words):
        _ctx_flags.append(f"max(CASE WHEN contains({TXT}, {q(_w)}) THEN 1 ELSE 0 END) AS {_cat}__{_i}")
        _names.append(f"coalesce({_cat}__{_i}, 0)")
    _ctx_cols.append(f"({' + '.join(_names)}) AS {_cat}_mentions")
    _ctx_parts.append(f"least(({' + '.join(_names)}) * 30, 250)")
register("context_score", f"""
WITH f AS (SELECT count(*) AS articles, {', '.join(_ctx_flags)}
           FROM (SELECT *, {RELEVANCE} AS relevance_score FROM articles) WHERE relevance_score >= 1)
SELECT articles, {', '.join(_ctx_cols)},
  CASE WHEN articles = 0 THEN CAST(0.0 AS DOUBLE)
       ELSE CAST(least({' + '.join(_ctx_parts)} + least(articles * 15, 200), 1000) AS DOUBLE) / 100.0 END AS context_score
FROM f
""")
register("search_funnel", f"""
WITH s AS (SELECT count(*) AS total_entries,
  count(*) FILTER (WHERE NOT {SEARCH_ANY}) AS rejected_no_terms,
  count(*) FILTER (WHERE {SEARCH_ANY} AND published IS NOT NULL AND published < {AS_OF} - 120) AS rejected_old_date,
  count(*) FILTER (WHERE {SEARCH_ANY} AND NOT (published IS NOT NULL AND published < {AS_OF} - 120)) AS accepted
FROM articles)
SELECT *, {half_up('accepted', 'total_entries', 1000, '10.0')} AS approval_rate FROM s
""")
_TERMS_LIST = "[" + ", ".join(q(t) for t in P.SEARCH_TERMS) + "]"
register("matching_terms", f"""
WITH m AS (SELECT article_id, list_filter({_TERMS_LIST}, lambda t: contains({TXT}, lower(t))) AS m FROM articles)
SELECT article_id, array_to_string(list_slice(m, 1, 5), ', ') AS matching_terms, CAST(len(m) AS INTEGER) AS terms_matched
FROM m WHERE len(m) > 0
""")
register("truncate_summary", "SELECT article_id, CASE WHEN length(summary) > 300 THEN concat(substr(summary, 1, 300), '...') ELSE summary END AS summary_short FROM articles")
_HEUR = ", ".join(f"count(*) FILTER (WHERE {any_in(TXT, w)}) AS {n}" for n, w in P.HEURISTIC_THEMES)
register("heuristic_analysis", f"""
WITH c AS (SELECT count(*) AS articles, {_HEUR}
           FROM (SELECT *, {RELEVANCE} AS relevance_score FROM articles) WHERE relevance_score >= 1),
g AS (SELECT rate AS growth_rate FROM {sub('case_increase_rate')} x)
SELECT articles, increase, deaths, hospitalization, vaccination, growth_rate,
  CASE WHEN articles = 0 THEN 'Nenhuma notícia relevante encontrada para análise.'
  ELSE concat('Análise de Contexto de Notícias (', CAST(articles AS VARCHAR), ' artigos analisados):', chr(10),
              chr(10), chr(10), 'Temas identificados nas notícias:', chr(10), '- Aumento de casos: ', CAST(increase AS VARCHAR),
              ' artigos', chr(10), '- Mortalidade: ', CAST(deaths AS VARCHAR), ' artigos', chr(10), '- Hospitalização: ',
              CAST(hospitalization AS VARCHAR), ' artigos', chr(10), '- Vacinação: ', CAST(vaccination AS VARCHAR), ' artigos', chr(10),
              CASE WHEN growth_rate > 10 AND increase > 0 THEN concat(chr(10), chr(10), 'As notícias refletem o aumento de casos observado nas métricas.') ELSE '' END)
  END AS analysis
FROM c, g
""")
_r = numtxt("rate")
register("metric_explanations", f"""
SELECT metric, rate, CASE
  WHEN metric = 'case_increase_rate' AND rate > 10 THEN concat('A taxa de aumento de ', {_r}, '% é significativa e indica crescimento acelerado nos casos. Recomenda-se intensificar monitoramento.')
  WHEN metric = 'case_increase_rate' AND rate > 0 THEN concat('A taxa de aumento de ', {_r}, '% indica crescimento moderado. Manutenção de vigilância é recomendada.')
  WHEN metric = 'case_increase_rate' THEN 'A taxa de aumento é estável ou em declínio, indicando tendência positiva.'
  WHEN metric = 'mortality_rate' THEN concat('A taxa de mortalidade de ', {_r}, '% reflete a gravidade dos casos. Monitorar recursos de saúde é essencial.')
  WHEN metric = 'icu_occupancy_rate' AND rate > 80 THEN concat('Ocupação de UTI de ', {_r}, '% está crítica. Ação imediata para aumento de capacidade é necessária.')
  WHEN metric = 'icu_occupancy_rate' THEN concat('Ocupação de UTI de ', {_r}, '% está dentro dos limites operacionais.')
  WHEN metric = 'vaccination_rate' AND rate > 70 THEN concat('Taxa de vacinação de ', {_r}, '% é boa e fornece proteção populacional.')
  WHEN metric = 'vaccination_rate' THEN concat('Taxa de vacinação de ', {_r}, '% indica necessidade de intensificar campanhas.')
  END AS explanation
FROM {sub('metrics_bundle')} b
""")
register("article_flow", f"""
WITH kept AS (SELECT * FROM articles WHERE {SEARCH_ANY} AND (published IS NULL OR published >= {AS_OF} - 120)),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(title, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) ORDER BY article_id) AS rn
       FROM kept WHERE title IS NOT NULL AND regexp_replace(title, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') <> '') WHERE rn = 1),
sc AS (SELECT *, {RELEVANCE} AS relevance_score FROM dd),
top AS (SELECT * FROM sc WHERE relevance_score >= 1 ORDER BY relevance_score DESC, article_id LIMIT 15)
SELECT {_ACOLS}, relevance_score, {_THEMES_JOINED} AS themes, strftime(published, '%d/%m/%Y') AS published_br FROM top
""")

# ===================================================================== report
register("executive_summary", f"""
WITH w AS (SELECT {_rate_of('case_increase_rate')} AS g, {_rate_of('mortality_rate')} AS m, {_rate_of('icu_occupancy_rate')} AS i
           FROM {sub('metrics_bundle')} b),
c AS (SELECT context_score AS s FROM {sub('context_score')} x)
SELECT g AS case_increase_rate, m AS mortality_rate, i AS icu_occupancy_rate, s AS context_score,
  concat(concat_ws('. ',
    CASE WHEN g > 10 THEN concat('Observado aumento significativo de ', {numtxt('g')}, '% nos casos')
         WHEN g < -10 THEN concat('Observada diminuição de ', {numtxt('abs(g)')}, '% nos casos')
         ELSE 'Número de casos relativamente estável' END,
    CASE WHEN m > 15 THEN concat('Taxa de mortalidade alta: ', {numtxt('m')}, '%')
         WHEN m < 5 THEN concat('Taxa de mortalidade baixa: ', {numtxt('m')}, '%')
         ELSE concat('Taxa de mortalidade moderada: ', {numtxt('m')}, '%') END,
    CASE WHEN i > 40 THEN concat('Alta demanda por UTI: ', {numtxt('i')}, '% dos casos')
         ELSE concat('Demanda por UTI: ', {numtxt('i')}, '% dos casos') END,
    CASE WHEN s > 7 THEN 'Notícias confirmam tendências observadas nas métricas'
         WHEN s > 4 THEN 'Notícias parcialmente relacionadas às métricas'
         ELSE 'Limitada correlação entre notícias e métricas' END), '.') AS executive_summary
FROM w, c
""")
register("vaccination_split", f"""
SELECT total_cases, vaccinated_cases, unvaccinated_cases, {half_up('vaccinated_cases', 'total_cases')} AS vaccinated_pct,
  {half_up('unvaccinated_cases', 'total_cases')} AS unvaccinated_pct FROM {sub('vaccination_rate')} v
""")
register("format_instant_br", "SELECT event_id, strftime(timezone('America/Sao_Paulo', ts AT TIME ZONE 'UTC'), '%d/%m/%Y às %H:%M:%S') AS ts_br FROM events")
register("report_figures", f"""
SELECT (SELECT count(*) FROM {sub('metrics_bundle')} b) AS metrics_count,
  CAST((SELECT count(*) > 0 FROM {sub('daily_calendar_fill')} d) AS INTEGER) + CAST((SELECT count(*) > 0 FROM {sub('monthly_counts')} m) AS INTEGER) AS charts_generated,
  (SELECT count(*) FROM {sub('article_flow')} a) AS news_articles_analyzed
""")

# The file sinks read back what they wrote: the header of the landed CSV, and
# the rows of the report.
register("src_delimiter", "SELECT ';' AS delimiter, CAST((SELECT count(*) + 1 FROM (DESCRIBE SELECT * FROM raw_cases)) AS INTEGER) AS semicolons, CAST(0 AS INTEGER) AS commas")
ORACLE["sink_quality_json"] = ORACLE["quality_report"]

# The rules of the report document, restated as text.
_RULES = """
('required_fields', 'DT_NOTIFIC', ''), ('required_fields', 'NU_NOTIFIC', ''),
('date_fields', 'DT_NOTIFIC', ''), ('date_fields', 'DT_EVOLUCA', ''), ('date_fields', 'DT_INTERNA', ''), ('date_fields', 'DT_SIN_PRI', ''),
('date_fields', 'DT_NASC', ''), ('date_fields', 'DT_COLETA', ''), ('date_fields', 'DT_PCR', ''), ('date_fields', 'DT_DIGITA', ''),
('numeric_ranges', 'NU_IDADE_N', '0..120'),
('categorical_values', 'CS_SEXO', 'M|F|I|'), ('categorical_values', 'EVOLUCAO', '1|2|3|9|'), ('categorical_values', 'UTI', '1|2|9|'),
('categorical_values', 'SUPORT_VEN', '1|2|9|'), ('categorical_values', 'VACINA_COV', '1|2|9|'), ('categorical_values', 'DOSE_1_COV', '1|2|9|'),
('categorical_values', 'DOSE_2_COV', '1|2|9|'), ('categorical_values', 'DOSE_REF', '1|2|9|'), ('categorical_values', 'HOSPITAL', '1|2|9|'),
('temporal_consistency', 'DT_NOTIFIC', 'DT_EVOLUCA'), ('temporal_consistency', 'DT_SIN_PRI', 'DT_NOTIFIC'), ('temporal_consistency', 'DT_INTERNA', 'DT_NOTIFIC'),
('business_rules', 'uti_requires_internment', 'UTI=1 requer internação hospitalar'), ('business_rules', 'death_without_symptoms', 'Óbito sem sintomas registrados'),
('business_rules', 'vaccination_consistency', 'Consistência nas doses de vacina'),
('outlier_detection', 'NU_IDADE_N', 'iqr 1.5'),
('duplicate_keys', 'DT_NOTIFIC', ''), ('duplicate_keys', 'SG_UF_NOT', ''), ('duplicate_keys', 'NU_IDADE_N', ''), ('duplicate_keys', 'CS_SEXO', ''),
('thresholds', 'null_warning_percent', '50.0'), ('thresholds', 'outlier_warning_percent', '5.0'), ('thresholds', 'score_per_error', '10.0'),
('thresholds', 'score_per_warning', '2.0'), ('thresholds', 'score_duplicate_weight', '20.0')
"""
register("sink_quality_document", f"""
SELECT 'metadata' AS section, 'generated_at' AS name, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS DOUBLE) AS value, '2001-06-01T00:00:00Z' AS text
UNION ALL SELECT 'metadata', 'records', NULL, value, NULL FROM {sub('quality_report')} r1 WHERE "check" = 'summary' AND field = 'total_records'
UNION ALL SELECT 'summary', field, NULL, value, NULL FROM {sub('quality_report')} r2 WHERE "check" = 'summary' AND field <> 'total_records'
UNION ALL SELECT 'rules', rule, field, NULL, value FROM (VALUES {_RULES}) AS t(rule, field, value)
UNION ALL SELECT 'details', "check", concat_ws('/', severity, field), NULL, message FROM {sub('quality_report')} r3 WHERE "check" <> 'summary'
""")

_DETAILED = "(" + DETAILED_CASES_SQL.format(raw_cases="raw_cases") + ") AS detailed"
register("decode_vaccination", f"""
SELECT NU_NOTIFIC, v AS VACINA_COV, CASE v WHEN '1' THEN 'Sim' WHEN '2' THEN 'Não' WHEN '9' THEN 'Ignorado' END AS VACINA_COV_DESC
FROM (SELECT NU_NOTIFIC, CASE WHEN replace(VACINA_COV, '.0', '') IN ('1', '2', '9') THEN replace(VACINA_COV, '.0', '') END AS v FROM {_DETAILED}) AS t
""")
register("age_from_birth_date", f"""
SELECT NU_NOTIFIC, b AS DT_NASC, CAST(floor(datediff('day', b, {AS_OF}) / 365) AS BIGINT) AS IDADE_CALCULADA
FROM (SELECT NU_NOTIFIC, CAST(try_strptime(DT_NASC, '%Y-%m-%d') AS DATE) AS b FROM {_DETAILED}) AS t
""")
register("q_temporal_pairs", " UNION ALL ".join(f"""
(WITH d AS (SELECT try_strptime({first}, '%Y-%m-%d') AS a, try_strptime({second}, '%Y-%m-%d') AS b FROM {_DETAILED}),
s AS (SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND b < a) AS x,
             count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS c FROM d)
SELECT '{first}_vs_{second}' AS pair, x AS inconsistent_count, c AS total_comparable,
  CASE WHEN c > 0 THEN {half_up('c - x', 'c')} ELSE CAST(100.0 AS DOUBLE) END AS consistency_rate,
  CASE WHEN x > 0 THEN 'error' END AS severity,
  CASE WHEN x > 0 THEN concat('Inconsistência temporal: ', CAST(x AS VARCHAR), ' registros onde ''{second}'' é anterior a ''{first}''') END AS message
FROM s)""" for first, second in (("DT_NOTIFIC", "DT_EVOLUCA"), ("DT_SIN_PRI", "DT_NOTIFIC"), ("DT_INTERNA", "DT_NOTIFIC"))))
