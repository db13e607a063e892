"""Typing, cleaning and derived clinical fields.

Every operator is a lazy ``DataFrame -> DataFrame`` function made of
native Column expressions, applied with one ``withColumns`` so the whole
chain stays a single projection inside whole-stage codegen.  Optional
columns are looked up in the schema when the plan is built; an absent
column simply contributes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions.numbers import to_number


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    names = set(df.columns)
    return [c for c in cols if c in names]


def _is_type(df: DataFrame, col: str, kind) -> bool:
    return isinstance(df.schema[col].dataType, kind)


# ---------------------------------------------------------------- P1 dates
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"


def iso_date(col) -> Column:
    """yyyy-mm-dd text -> date; single-digit month/day accepted; bad -> NULL.

    Same accepted inputs as ``try_to_date(c, 'yyyy-M-d')`` (no spaces, no
    time part, real calendar dates only), but the shape test plus a cast
    is cheaper than the pattern parser on every row.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(ISO_SHAPE), c.try_cast("date"))


def br_date(col) -> Column:
    """dd/mm/yyyy text -> date; bad -> NULL."""
    return F.try_to_date(F.col(col) if isinstance(col, str) else col, "d/M/yyyy")


def parse_dates(df: DataFrame, iso_cols: Sequence[str] = P.ISO_DATE_COLUMNS,
                br_cols: Sequence[str] = P.BR_DATE_COLUMNS) -> DataFrame:
    """Parse ISO and Brazilian date columns; columns already typed are kept."""
    out: dict[str, Column] = {}
    for c in _present(df, iso_cols):
        if not _is_type(df, c, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[c] = iso_date(c)
    for c in _present(df, br_cols):
        if not _is_type(df, c, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[c] = br_date(c)
    return df.withColumns(out) if out else df


# ---------------------------------------------------------------- P2 codes
def clean_code(col: str, valid: Sequence[str]) -> Column:
    """'1.0' -> '1', trimmed; anything outside the whitelist -> NULL."""
    v = F.trim(F.replace(F.col(col).cast("string"), F.lit(".0"), F.lit("")))
    return F.when(v.isin(list(valid)), v)


def clean_codes(df: DataFrame, whitelists: dict[str, Sequence[str]] = P.CODE_WHITELISTS) -> DataFrame:
    out = {c: clean_code(c, whitelists[c]) for c in _present(df, list(whitelists))}
    return df.withColumns(out) if out else df


# ---------------------------------------------------------------- P3 / P4
def clean_age_expr(col: str = P.AGE_COL, lo: float = P.AGE_MIN, hi: float = P.AGE_MAX) -> Column:
    a = to_number(col)
    return F.when(a.between(lo, hi), a)


def clean_age(df: DataFrame, col: str = P.AGE_COL) -> DataFrame:
    return df.withColumn(col, clean_age_expr(col)) if col in df.columns else df


def clean_symptoms(df: DataFrame, cols: Sequence[str] = P.SYMPTOM_COLUMNS) -> DataFrame:
    out = {c: to_number(c) for c in _present(df, cols)}
    return df.withColumns(out) if out else df


def clean(df: DataFrame) -> DataFrame:
    """P1-P4 in one projection."""
    return clean_symptoms(clean_age(clean_codes(parse_dates(df))))


# ---------------------------------------------------------------- P5 - P12
def age_band_expr(col: str = P.AGE_COL, edges: Sequence[float] = P.AGE_BAND_EDGES,
                  labels: Sequence[str] = P.AGE_BAND_LABELS, include_lowest: bool = True) -> Column:
    """Right-closed bins ``(e[i], e[i+1]]``; the first bin also takes ``e[0]``."""
    a = F.col(col)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (a >= lo) if (i == 0 and include_lowest) else (a > lo)
        cond = cond & (a <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def outcome_label_expr(col: str = P.OUTCOME_COL) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in P.OUTCOME_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(mapping, F.col(col)), F.lit(P.OUTCOME_DEFAULT))


def flag_expr(cond: Column) -> Column:
    """Boolean -> 0/1 with NULL -> 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def icu_flag_expr(col: str = P.ICU_COL) -> Column:
    return flag_expr(F.col(col) == "1")


def death_flag_expr(col: str = P.OUTCOME_COL) -> Column:
    return flag_expr(F.col(col).isin(P.DEATH_CODES))


def _any_present(cols: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in cols]).isNotNull() if len(cols) > 1 else F.col(cols[0]).isNotNull()


def vaccination_status_expr(available: Sequence[str]) -> Column:
    """Dose-date cascade over the dose columns that exist.

    Rules are written from the last applied to the first, so the first
    matching ``when`` is the rule that would have won.
    """
    avail = [c for c in P.STATUS_DOSE_COLUMNS if c in available]
    if not avail:
        return F.lit(P.VAX_UNKNOWN)
    has = {c: F.col(c).isNotNull() for c in avail}
    rules: list[tuple[Column, str]] = []
    extra = [c for c in ("DOSE_2REF", "DOSE_ADIC") if c in has]
    boosters = [c for c in ("DOSE_REF", "DOSE_2REF", "DOSE_ADIC") if c in has]
    if extra:
        rules.append((_any_present(extra), P.VAX_EXTRA))
    if "DOSE_REF" in has:
        rules.append((has["DOSE_REF"] & ~_any_present(extra) if extra else has["DOSE_REF"], P.VAX_BOOSTER))
    if "DOSE_2_COV" in has:
        rules.append((has["DOSE_2_COV"] & ~_any_present(boosters) if boosters else has["DOSE_2_COV"], P.VAX_TWO))
    if "DOSE_1_COV" in has:
        rules.append((has["DOSE_1_COV"] & ~has["DOSE_2_COV"] if "DOSE_2_COV" in has else has["DOSE_1_COV"], P.VAX_ONE))
    rules.append((~_any_present(avail), P.VAX_NONE))
    expr = None
    for cond, label in rules:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(P.VAX_UNKNOWN))


def symptom_count_expr(available: Sequence[str]) -> Column:
    cols = [c for c in P.COUNTED_SYMPTOMS if c in available]
    total = F.lit(0)
    for c in cols:
        total = total + flag_expr(F.col(c) == 1)
    return total


def age_risk_expr(col: str = P.AGE_COL) -> Column:
    a = F.col(col)
    return F.when((a >= 60) | (a < 2), F.lit("Alto")).otherwise(F.lit("Baixo"))


def calendar_exprs(col: str = P.DATE_COL) -> dict[str, Column]:
    d = F.col(col)
    return {"ANO": F.year(d), "MES": F.month(d), "SEMANA_EPI": F.weekofyear(d)}


def derive(df: DataFrame) -> DataFrame:
    """P5-P12 as one projection (columns are added only when inputs exist)."""
    cols = set(df.columns)
    out: dict[str, Column] = {}
    if P.AGE_COL in cols:
        out["FAIXA_ETARIA"] = age_band_expr()
    if P.OUTCOME_COL in cols:
        out["EVOLUCAO_SIMPLES"] = outcome_label_expr()
    if P.ICU_COL in cols:
        out["CASO_GRAVE"] = icu_flag_expr()
    out["STATUS_VACINAL_COVID"] = vaccination_status_expr(list(cols))
    if any(c in cols for c in P.COUNTED_SYMPTOMS):
        out["NUM_SINTOMAS"] = symptom_count_expr(list(cols))
    if P.DATE_COL in cols:
        out.update(calendar_exprs())
    if P.AGE_COL in cols:
        out["GRUPO_RISCO_IDADE"] = age_risk_expr()
    if P.OUTCOME_COL in cols:
        out["TEVE_OBITO"] = death_flag_expr()
    if P.ICU_COL in cols:
        out["TEVE_UTI"] = icu_flag_expr()
    return df.withColumns(out)


def process(df: DataFrame) -> DataFrame:
    """Raw strings -> typed, cleaned and derived case table (row-preserving)."""
    return derive(clean(df))


# ---------------------------------------------------------------- P13 - P15
def decode_codes(df: DataFrame, labels=P.CODE_LABELS, suffix: str = "_DESC") -> DataFrame:
    """Code -> label for every field of the dictionary that exists.

    The dictionary is a fixed 13-entry literal map, so the lookup is a
    per-row map access with no join at all.
    """
    out = {}
    fields = sorted({f for f, _, _ in labels}, key=[f for f, _, _ in labels].index)
    for f in _present(df, fields):
        m = F.create_map(*[F.lit(x) for fld, code, label in labels if fld == f for x in (code, label)])
        out[f + suffix] = F.element_at(m, F.col(f))
    return df.withColumns(out) if out else df


def age_from_birth_expr(birth_col: str, as_of: str) -> Column:
    """Whole years as ``floor(days / 365)`` at ``as_of``."""
    return F.floor(F.datediff(F.to_date(F.lit(as_of)), F.col(birth_col)) / 365)


def anonymised_age_expr(col: str = P.AGE_COL, step: int = P.AGE_ROUND_STEP) -> Column:
    """G3 age floor: ``int(x/step)*step`` (truncation toward zero)."""
    a = F.col(col)
    return (F.when(a >= 0, F.floor(a / step)).otherwise(F.ceil(a / step)) * step).cast("double")
