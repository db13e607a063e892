"""Privacy and content guardrails.

All are per-row Column expressions (``regexp_replace``, ``contains``,
``sha2``); no Python UDF.  Redaction of a whole frame walks the schema
once on the driver and builds a single ``select`` (nested structs via
``transform``-free struct rebuilds, arrays via ``transform``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions import text as TX
from .cleaning import age_band_expr, anonymised_age_expr


def anonymise_columns(df: DataFrame, sensitive: Sequence[str] = P.SENSITIVE_COLUMNS) -> DataFrame:
    """G1: drop sensitive columns that exist."""
    present = [c for c in sensitive if c in df.columns]
    return df.drop(*present) if present else df


def is_sensitive_name(name: str, sensitive: Sequence[str] = P.SENSITIVE_COLUMNS_SETTINGS) -> bool:
    """Case-insensitive name test of the settings list."""
    return name.upper() in {c.upper() for c in sensitive}


def sensitive_columns(df: DataFrame, sensitive: Sequence[str] = P.SENSITIVE_COLUMNS_SETTINGS) -> list[str]:
    """Columns of ``df`` named in the settings list (case-insensitive)."""
    return [c for c in df.columns if is_sensitive_name(c, sensitive)]


def generalise_location(df: DataFrame) -> DataFrame:
    """Drop the municipality when the state is present."""
    if P.MUNI_COL in df.columns and P.STATE_COL in df.columns:
        return df.drop(P.MUNI_COL)
    return df


def anonymise_age(df: DataFrame, col: str = P.AGE_COL) -> DataFrame:
    """Guardrail age band (0-12 / 13-18 / 19-60 / 60+) and age floored to 5."""
    if col not in df.columns:
        return df
    return df.withColumns({
        "FAIXA_ETARIA": age_band_expr(col, labels=P.ANON_AGE_BAND_LABELS),
        col: anonymised_age_expr(col),
    })


def anonymise_cases(df: DataFrame) -> DataFrame:
    """G9 = G1 + G2 + G3."""
    return anonymise_age(generalise_location(anonymise_columns(df)))


def _marked(name: str, markers: Sequence[str]) -> bool:
    low = name.lower()
    return any(m in low for m in markers)


def _redact_value(col: Column, dtype: T.DataType, markers: Sequence[str]) -> Column:
    if isinstance(dtype, T.StringType):
        return TX.redact(col)
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            sub = col.getField(f.name)
            if _marked(f.name, markers):
                fields.append(F.lit(P.REDACTED_FIELD_TEXT).alias(f.name))
            else:
                fields.append(_redact_value(sub, f.dataType, markers).alias(f.name))
        return F.when(col.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _redact_value(x, dtype.elementType, markers))
    if isinstance(dtype, T.MapType):
        named = isinstance(dtype.keyType, T.StringType)
        fixed = F.lit(P.REDACTED_FIELD_TEXT if isinstance(dtype.valueType, T.StringType) else None).cast(dtype.valueType)
        return F.transform_values(col, lambda k, v: F.when(TX.any_of(F.lower(k), markers), fixed).otherwise(
            _redact_value(v, dtype.valueType, markers)) if named else _redact_value(v, dtype.valueType, markers))
    return col


def redact_frame(df: DataFrame, markers: Sequence[str] = P.PERSONAL_FIELD_MARKERS) -> DataFrame:
    """A column, struct field or map entry whose lower-cased name contains
    a marker becomes a fixed text (a map entry of another type becomes null);
    every other string, at any depth, is redacted."""
    cols = []
    for f in df.schema.fields:
        if _marked(f.name, markers):
            cols.append(F.lit(P.REDACTED_FIELD_TEXT).alias(f.name))
        else:
            cols.append(_redact_value(F.col(f.name), f.dataType, markers).alias(f.name))
    return df.select(*cols)


def article_appropriate_expr(title="title", content="summary", source="source",
                             prohibited: Sequence[str] = P.PROHIBITED_TERMS,
                             reliable: Sequence[str] = P.RELIABLE_SOURCES,
                             suspicious: Sequence[str] = P.SUSPICIOUS_TERMS) -> Column:
    """Prohibited term -> reject; else reliable source -> accept; else
    suspicious term -> reject; else accept."""
    text = F.concat(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit(" "), F.lower(F.coalesce(F.col(content), F.lit(""))))
    src = F.lower(F.coalesce(F.col(source), F.lit("")))
    return (F.when(TX.any_of(text, prohibited), F.lit(False))
            .when(TX.any_of(src, reliable), F.lit(True))
            .when(TX.any_of(text, suspicious), F.lit(False))
            .otherwise(F.lit(True)))


def fingerprint_expr(*parts: Column) -> Column:
    """``SRAG-`` + first 16 hex digits of SHA-256 over the content."""
    body = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(P.FINGERPRINT_PREFIX), F.substring(F.sha2(body, 256), 1, 16))


def _strings(col: Column, dtype: T.DataType) -> Column | None:
    """All strings of a value at any depth, as one array; None if it can hold none."""
    if isinstance(dtype, T.StringType):
        return F.array(col)
    if isinstance(dtype, T.StructType):
        parts = [s for f in dtype.fields if (s := _strings(col.getField(f.name), f.dataType)) is not None]
    elif isinstance(dtype, T.ArrayType):
        if _strings(F.lit(None), dtype.elementType) is None:
            return None
        parts = [F.flatten(F.transform(col, lambda x: _strings(x, dtype.elementType)))]
    elif isinstance(dtype, T.MapType):
        parts = [s for s in (_strings(F.map_keys(col), T.ArrayType(dtype.keyType)), _strings(F.map_values(col), T.ArrayType(dtype.valueType))) if s is not None]
    else:
        return None
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]) if parts else None


def _any_match(strings: Column, pattern: str) -> Column:
    return F.exists(strings, lambda x: x.rlike(pattern))


def pii_scan(df: DataFrame) -> DataFrame:
    """Per column that holds strings at any depth (struct fields, array
    elements, map keys and values), the rows that still match the CPF, phone
    and e-mail patterns of the leak check."""
    aggs, rows = [], []
    for f in df.schema.fields:
        held = _strings(F.col(f.name), f.dataType)
        if held is None:
            continue
        for kind, pattern in (("cpf", P.CPF_PATTERN), ("phone", P.PHONE_PATTERN), ("email", P.EMAIL_SCAN_PATTERN)):
            hit = F.col(f.name).rlike(pattern) if isinstance(f.dataType, T.StringType) else _any_match(held, pattern)
            aggs.append(F.count_if(hit).alias(f"{f.name}__{kind}"))
        rows.append(F.struct(F.lit(f.name).alias("column"), *[F.col(f"`{f.name}__{k}`").alias(f"{k}_hits") for k in ("cpf", "phone", "email")]))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
