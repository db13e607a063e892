"""Parameters and fixed values.

Everything here is data, no logic.  Operators take these as keyword
defaults so a caller can pass their own lists, limits and windows.

The lists under "FIXED VALUES" must stay equal to the behaviour we
match (keyword lists, labels, limits, patterns).  They are kept in
their natural order; the relevance list is a multiset on purpose
(one entry appears twice and so counts twice).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Column roles of the case table
# ---------------------------------------------------------------------------
DATE_COL = "DT_NOTIFIC"
ID_COL = "NU_NOTIFIC"
STATE_COL = "SG_UF_NOT"
MUNI_COL = "CO_MUN_NOT"
SEX_COL = "CS_SEXO"
AGE_COL = "NU_IDADE_N"
ICU_COL = "UTI"
HOSP_COL = "HOSPITAL"
OUTCOME_COL = "EVOLUCAO"
OUTCOME_DATE_COL = "DT_EVOLUCA"

# ===========================================================================
# FIXED VALUES (must equal the reference behaviour)
# ===========================================================================

# Columns the loader keeps when present in the header.
ESSENTIAL_COLUMNS = [
    "DT_NOTIFIC", "SG_UF_NOT", "CO_MUN_NOT", "CS_SEXO", "NU_IDADE_N", "UTI",
    "SUPORT_VEN", "EVOLUCAO", "DT_EVOLUCA", "HOSPITAL", "DT_INTERNA",
    "VACINA_COV", "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "FEBRE", "TOSSE",
    "DISPNEIA", "DESC_RESP", "SATURACAO", "DIARREIA", "VOMITO",
]

# Date columns written as yyyy-mm-dd.
ISO_DATE_COLUMNS = [
    "DT_NOTIFIC", "DT_SIN_PRI", "DT_NASC", "DT_EVOLUCA", "DT_ENCERRA",
    "DT_DIGITA", "DT_INTERNA", "DT_COLETA", "DT_PCR", "DT_ENTUTI",
    "DT_SAIDUTI", "DT_RAIOX", "DT_ANTIVIR", "DT_TOMO", "DT_CO_SOR", "DT_RES",
    "DT_TRT_COV", "VG_DTRES", "DT_UT_DOSE", "DT_VAC_MAE",
]

# Date columns written as dd/mm/yyyy (vaccine doses).
BR_DATE_COLUMNS = [
    "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC",
    "DOS_RE_BI", "DT_DOSEUNI", "DT_1_DOSE", "DT_2_DOSE",
]

# Code whitelists applied by the cleaner.
CODE_WHITELISTS = {
    "CS_SEXO": ["M", "F", "I"],
    "EVOLUCAO": ["1", "2", "3", "9"],
    "UTI": ["1", "2", "9"],
    "SUPORT_VEN": ["1", "2", "9"],
    "VACINA_COV": ["1", "2", "9"],
    "HOSPITAL": ["1", "2", "9"],
}

SYMPTOM_COLUMNS = ["FEBRE", "TOSSE", "DISPNEIA", "DESC_RESP", "SATURACAO", "DIARREIA", "VOMITO"]
# Symptoms counted in NUM_SINTOMAS and in the death-without-symptom rule.
COUNTED_SYMPTOMS = ["FEBRE", "TOSSE", "DISPNEIA", "DESC_RESP", "DIARREIA", "VOMITO"]

AGE_MIN, AGE_MAX = 0, 120
AGE_BAND_EDGES = [0, 12, 18, 60, 120]
AGE_BAND_LABELS = ["Criança", "Adolescente", "Adulto", "Idoso"]
ANON_AGE_BAND_LABELS = ["0-12", "13-18", "19-60", "60+"]
AGE_ROUND_STEP = 5

OUTCOME_LABELS = {"1": "Cura", "2": "Óbito", "3": "Óbito por outras causas"}
OUTCOME_DEFAULT = "Ignorado"
DEATH_CODES = ["2", "3"]

# Vaccination status labels, from "nothing" to "most doses".
VAX_NONE = "Não vacinado"
VAX_ONE = "1ª dose apenas"
VAX_TWO = "Esquema completo (2 doses)"
VAX_BOOSTER = "Com dose de reforço"
VAX_EXTRA = "Com reforços adicionais"
VAX_UNKNOWN = "Não informado"
STATUS_DOSE_COLUMNS = ["DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC"]
RATE_DOSE_COLUMNS = ["DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC", "DOS_RE_BI"]
DOSE_BREAKDOWN = [
    ("dose_1", "DOSE_1_COV"),
    ("dose_2", "DOSE_2_COV"),
    ("dose_booster", "DOSE_REF"),
    ("dose_2nd_booster", "DOSE_2REF"),
    ("dose_additional", "DOSE_ADIC"),
]

# Code -> label dictionary (field, code, label).
CODE_LABELS = [
    ("EVOLUCAO", "1", "Cura"),
    ("EVOLUCAO", "2", "Óbito por SRAG"),
    ("EVOLUCAO", "3", "Óbito por outras causas"),
    ("EVOLUCAO", "9", "Ignorado"),
    ("CS_SEXO", "M", "Masculino"),
    ("CS_SEXO", "F", "Feminino"),
    ("CS_SEXO", "I", "Ignorado"),
    ("UTI", "1", "Sim"),
    ("UTI", "2", "Não"),
    ("UTI", "9", "Ignorado"),
    ("VACINA_COV", "1", "Sim"),
    ("VACINA_COV", "2", "Não"),
    ("VACINA_COV", "9", "Ignorado"),
]

# Default look-back windows (days) of the four rates.
DEFAULT_PERIODS = {
    "case_increase_rate": 30,
    "mortality_rate": 90,
    "icu_occupancy_rate": 30,
    "vaccination_rate": 90,
}
PERIOD_PRESETS = {"weekly": 7, "monthly": 30, "quarterly": 90}
HISTORICAL_DAYS = 1095

# Metric limits used by the metric check: (metric, min, max, warning threshold).
METRIC_LIMITS = [
    ("mortality_rate", 0.0, 50.0, 30.0),
    ("icu_occupancy_rate", 0.0, 100.0, 80.0),
    ("vaccination_rate", 0.0, 100.0, 95.0),
    ("case_increase_rate", -100.0, 1000.0, 200.0),
]
# Alert thresholds: (metric, kind, value).
ALERT_THRESHOLDS = [
    ("case_increase_rate", "warning", 50.0),
    ("case_increase_rate", "critical", 100.0),
    ("mortality_rate", "warning", 15.0),
    ("mortality_rate", "critical", 25.0),
    ("icu_occupancy_rate", "warning", 60.0),
    ("icu_occupancy_rate", "critical", 80.0),
    ("vaccination_rate", "low_coverage", 50.0),
    ("vaccination_rate", "good_coverage", 80.0),
]
# Second min/max table of the settings module.
VALIDATION_LIMITS = [
    ("mortality_rate", 0.0, 50.0),
    ("icu_occupancy_rate", 0.0, 100.0),
    ("vaccination_rate", 0.0, 100.0),
    ("case_increase_rate", -99.0, 1000.0),
]

# Privacy.
SENSITIVE_COLUMNS = [
    "ID_MUNICIP", "NU_NOTIFIC", "CO_UNI_NOT", "NM_UNIDADE", "NM_MUNIC",
    "NM_PACIENT", "CPF", "IDENTIDADE",
]
SENSITIVE_COLUMNS_SETTINGS = ["NU_NOTIFIC", "DT_NASC", "DT_DIGITA"]
PERSONAL_FIELD_MARKERS = ["cpf", "rg", "nome", "endereco", "telefone", "email", "identidade", "paciente"]
REDACTED_FIELD_TEXT = "[informação removida por privacidade]"
CPF_PATTERN = r"\d{3}\.\d{3}\.\d{3}-\d{2}"
PHONE_PATTERN = r"\(\d{2}\)\s?\d{4,5}-?\d{4}"
API_SOURCE_DEFAULT = "News API"
# The leak check's own e-mail pattern (no word boundaries), not the redactor's.
EMAIL_SCAN_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CPF_REPLACEMENT = "[CPF removido]"
PHONE_REPLACEMENT = "[telefone removido]"
EMAIL_REPLACEMENT = "[email removido]"
PROHIBITED_TERMS = ["fake news", "teoria da conspiração", "negacionismo", "anti-vacina", "desinformação", "hoax"]
PROHIBITED_TERMS_SETTINGS = [
    "fake news", "teoria da conspiração", "negacionismo", "anti-vacina",
    "desinformação", "hoax", "golpe", "farsa", "mentira",
]
RELIABLE_SOURCES = [
    "g1.com", "folha.uol.com.br", "estadao.com.br", "bbc.com", "gov.br",
    "saude.gov.br", "fiocruz.br", "butantan.gov.br",
]
SUSPICIOUS_TERMS = ["milagre", "cura definitiva", "100% eficaz"]
MASK_TEXT = "[conteúdo filtrado]"
FINGERPRINT_PREFIX = "SRAG-"
GUARDRAILS_VERSION = "1.0"
PLAUSIBLE_MIN_DATE = "2000-01-01"

# Article search terms (a term matches when it is a substring of the
# lower-cased "title summary" text).
SEARCH_TERMS = [
    "SRAG", "síndrome respiratória aguda grave", "Síndrome Respiratória Aguda Grave",
    "covid", "covid-19", "coronavirus", "coronavírus",
    "gripe", "influenza", "h1n1", "h3n2",
    "pneumonia", "bronquite", "asma",
    "respiratória", "respiratório", "respiratoria", "respiratorio",
    "tosse", "falta de ar", "dispneia", "febre",
    "pulmão", "pulmao", "pulmonar",
    "uti", "UTI", "terapia intensiva",
    "internação", "internacao", "hospitalização", "hospitalizacao",
    "leito", "hospital",
    "caso grave", "casos graves",
    "surto", "epidemia", "pandemia",
    "casos", "notificação", "notificacao",
    "vigilância epidemiológica", "vigilancia epidemiologica",
    "aumento de casos", "alta de casos",
    "óbito", "obito", "morte", "mortalidade",
    "falecimento", "vítima", "vitima",
    "vacina", "vacinação", "vacinacao",
    "imunização", "imunizacao", "dose",
    "campanha de vacinação", "esquema vacinal",
    "doença respiratória", "doenca respiratoria",
    "infecção respiratória", "infeccao respiratoria",
    "vírus respiratório", "virus respiratorio",
    "saúde pública", "saude publica",
    "ministério da saúde", "ministerio da saude",
    "anvisa", "fiocruz", "butantan",
    "saturação", "oxigênio", "oxigenio",
    "respirador", "ventilação mecânica", "ventilacao mecanica",
]
NEWS_DATE_RANGE_DAYS = 120
MAX_ARTICLES = 10
PIPELINE_MAX_ARTICLES = 15
MATCHING_TERMS_SHOWN = 5

# Relevance keywords (a multiset: "respiratória" is listed twice).
RELEVANCE_KEYWORDS = [
    "srag", "síndrome respiratória", "respiratória aguda", "respiratoria aguda",
    "respiratória", "respiratorio", "respiratória", "respiratório",
    "pulmão", "pulmao", "pulmonar",
    "uti", "internação", "internacao", "hospital", "hospitalização",
    "terapia intensiva", "leito",
    "casos", "surto", "epidemia", "pandemia",
    "notificação", "notificacao", "vigilância", "vigilancia",
    "pneumonia", "covid", "influenza", "h1n1", "gripe", "resfriado",
    "vírus", "virus", "viral",
    "saúde", "saude", "doença", "doenca", "enfermidade",
    "óbito", "obito", "morte", "mortalidade", "falecimento",
    "vacina", "vacinação", "imunização", "dose",
    "febre", "tosse", "falta de ar", "dispneia", "saturação",
]

# Context-score keywords per metric category.
CONTEXT_KEYWORDS = {
    "cases": [
        "casos", "case", "notificações", "registros", "notificacao",
        "aumento", "crescimento", "alta", "dispara", "sobe", "cresce",
        "srag", "síndrome respiratória", "sindrome respiratoria",
    ],
    "mortality": [
        "óbito", "obito", "morte", "mortalidade", "falecimento",
        "vítima", "vitima", "letal", "fatal",
    ],
    "icu": [
        "uti", "terapia intensiva", "internação", "internacao",
        "hospital", "leito", "hospitalização", "hospitalizacao",
        "ocupação", "ocupacao",
    ],
    "vaccination": [
        "vacina", "vacinação", "vacinacao", "imunização", "imunizacao",
        "dose", "imunizado", "vacinado", "esquema vacinal",
        "campanha de vacinação", "campanha de vacinacao",
    ],
    "respiratory": [
        "respiratória", "respiratorio", "respiratoria", "respiratório",
        "covid", "gripe", "influenza", "pneumonia",
        "tosse", "falta de ar", "dispneia", "febre",
        "pulmão", "pulmao", "pulmonar",
    ],
}
CONTEXT_PER_KEYWORD = 0.3
CONTEXT_CATEGORY_CAP = 2.5
CONTEXT_PER_ARTICLE = 0.15
CONTEXT_ARTICLE_CAP = 2.0
CONTEXT_CAP = 10.0

# Theme tags per article (narrow lists).
ARTICLE_THEMES = [
    ("Aumento de casos", ["aumento", "alta", "crescimento", "dispara"]),
    ("Mortalidade", ["óbito", "morte", "mortalidade"]),
    ("Hospitalização", ["uti", "internação", "hospital"]),
    ("Vacinação", ["vacina", "vacinação", "imunização"]),
    ("Alerta", ["alerta", "preocupa", "risco"]),
    ("Prevenção", ["prevenção", "cuidados", "proteção"]),
]

# Theme counts of the news summary (wide lists).
WIDE_THEMES = [
    ("increase", ["aumento", "alta", "crescimento", "dispara", "cresce", "sobe"]),
    ("deaths", ["óbito", "morte", "mortalidade", "falecimento", "vítima"]),
    ("hospitalization", ["uti", "internação", "internacao", "hospital", "leito"]),
    ("vaccination", ["vacina", "vacinação", "imunização", "dose"]),
    ("alert", ["alerta", "atenção", "preocupa", "risco", "cuidado"]),
    ("prevention", ["prevenção", "prevenir", "evitar", "proteção", "cuidados"]),
]
THEME_TOP_N = 3

# Themes of the heuristic narrative.
HEURISTIC_THEMES = [
    ("increase", ["aumento", "alta", "crescimento"]),
    ("deaths", ["óbito", "morte"]),
    ("hospitalization", ["uti", "internação", "hospital"]),
    ("vaccination", ["vacina", "vacinação"]),
]

# Source-name simplification: (needle, case-insensitive?, label).
SOURCE_NAMES = [
    ("g1.globo.com", False, "G1"),
    ("folha", True, "Folha de S.Paulo"),
    ("estadao", True, "Estadão"),
    ("fiocruz", True, "Fiocruz"),
    ("news api", True, "News API"),
]

SUMMARY_MAX_CHARS = 300
DIGEST_MAX_CHARS = 200
BR_TIMEZONE = "America/Sao_Paulo"

# Quality rules.
REQUIRED_FIELDS = ["DT_NOTIFIC", "NU_NOTIFIC"]
QUALITY_DATE_FIELDS = ["DT_NOTIFIC", "DT_EVOLUCA", "DT_INTERNA", "DT_SIN_PRI", "DT_NASC", "DT_COLETA", "DT_PCR", "DT_DIGITA"]
NUMERIC_RANGES = {"NU_IDADE_N": (0, 120)}
CATEGORICAL_RULES = {
    "CS_SEXO": ["M", "F", "I", ""],
    "EVOLUCAO": ["1", "2", "3", "9", ""],
    "UTI": ["1", "2", "9", ""],
    "SUPORT_VEN": ["1", "2", "9", ""],
    "VACINA_COV": ["1", "2", "9", ""],
    "DOSE_1_COV": ["1", "2", "9", ""],
    "DOSE_2_COV": ["1", "2", "9", ""],
    "DOSE_REF": ["1", "2", "9", ""],
    "HOSPITAL": ["1", "2", "9", ""],
}
TEMPORAL_PAIRS = [("DT_NOTIFIC", "DT_EVOLUCA"), ("DT_SIN_PRI", "DT_NOTIFIC"), ("DT_INTERNA", "DT_NOTIFIC")]
DUPLICATE_KEYS = ["DT_NOTIFIC", "SG_UF_NOT", "NU_IDADE_N", "CS_SEXO"]
DEDUP_KEYS = ["DT_NOTIFIC", "CO_MUN_NOT", "NU_IDADE_N", "CS_SEXO"]
NULL_WARNING_PERCENT = 50.0
OUTLIER_WARNING_PERCENT = 5.0
IQR_FACTOR = 1.5
PERCENTILE_BOUNDS = (0.01, 0.99)
CATEGORICAL_EXAMPLES = 10
OUTLIER_SAMPLES = 5
SCORE_PER_ERROR = 10.0
SCORE_PER_WARNING = 2.0
SCORE_DUPLICATE_WEIGHT = 20.0

# Static fallback articles: (title, summary, days before as_of, source, score).
FALLBACK_ARTICLES = [
    (
        "Aumento de casos de SRAG requer monitoramento de UTI e vacinação urgente",
        "Ministério da Saúde alerta para crescimento significativo de casos de Síndrome Respiratória Aguda Grave (SRAG) no período recente. Hospitais reportam aumento expressivo nas internações em UTI com taxa de ocupação crescente. Mortalidade se mantém controlada em regiões com alta cobertura de vacinação contra COVID-19 e influenza. Autoridades recomendam intensificar campanhas de imunização e vigilância epidemiológica.",
        0, "Ministério da Saúde", 10,
    ),
    (
        "Taxa de mortalidade por SRAG reduz drasticamente com vacinação completa",
        "OpenDataSUS divulga dados demonstrando que a taxa de mortalidade por SRAG permanece significativamente mais baixa em áreas com alta cobertura vacinal. Análise de 90 dias mostra que casos graves diminuem em até 70% entre vacinados. UTI com menor ocupação e menos óbitos registrados onde imunização está em dia. Óbitos concentrados em população não vacinada.",
        1, "OpenDataSUS", 9,
    ),
    (
        "Vacinação contra COVID e influenza previne casos graves de doenças respiratórias",
        "Especialistas da FIOCRUZ reforçam que vacinação contra COVID-19 e influenza reduz drasticamente internações em UTI e óbitos por SRAG. Dados epidemiológicos mostram correlação direta entre baixa cobertura vacinal e aumento de casos graves com necessidade de terapia intensiva. Taxa de mortalidade cai significativamente em grupos com esquema vacinal completo.",
        2, "FIOCRUZ", 8,
    ),
    (
        "Vigilância epidemiológica identifica aumento de internações por síndrome respiratória",
        "Sistema de vigilância epidemiológica registra crescimento de 30% nas notificações de SRAG nos últimos 30 dias. Análise de séries temporais revela padrões preocupantes de casos, internações e ocupação de UTI. Taxa de mortalidade varia conforme status de vacinação. Dados auxiliam planejamento de ações urgentes de saúde pública e intensificação de campanhas de vacinação em regiões críticas.",
        3, "Agência FIOCRUZ", 8,
    ),
    (
        "Campanhas de vacinação intensificadas após aumento de internações respiratórias",
        "Ministério da Saúde amplia campanhas de vacinação em resposta ao crescimento de casos de doenças respiratórias graves. Foco especial em grupos prioritários para reduzir mortalidade e desafogar leitos de UTI. Imunização demonstra alta eficácia na redução de óbitos por SRAG. Hospitais reportam que maioria dos casos graves são de não vacinados.",
        4, "Butantan", 7,
    ),
    (
        "Ocupação de UTI por pacientes com SRAG atinge níveis preocupantes",
        "Hospitais em diversas regiões reportam crescimento alarmante na ocupação de leitos de UTI por casos de síndrome respiratória aguda grave. Taxa de ocupação ultrapassa 80% em algumas unidades. Mortalidade varia drasticamente conforme status vacinal dos pacientes internados. Necessidade urgente de ampliar capacidade de terapia intensiva e intensificar vacinação em regiões críticas.",
        5, "G1 Saúde", 7,
    ),
    (
        "Dados oficiais confirmam: vacinação reduz mortalidade por SRAG em 85%",
        "Estudo com dados de milhares de casos de SRAG comprova que pacientes com esquema vacinal completo têm taxa de mortalidade 85% menor. Internações em UTI também reduzem significativamente entre imunizados. Óbitos concentrados em não vacinados e grupos com dose incompleta. Autoridades de saúde recomendam urgentemente manter esquema vacinal completo contra doenças respiratórias.",
        6, "Estadão Saúde", 9,
    ),
]
FALLBACK_LINK = "#"

# ===========================================================================
# End of fixed values
# ===========================================================================


@dataclass(frozen=True)
class Windows:
    """Look-back windows of the metric bundle (days)."""

    growth: int = 30
    mortality: int = 90
    icu: int = 30
    vaccination: int = 90


@dataclass(frozen=True)
class ChartWindows:
    daily_days: int = 30
    monthly_days: int = 365
    moving_average_rows: int = 7


# Fixture reference date used by the registered queries.
FIXTURE_AS_OF = "2001-06-01"
