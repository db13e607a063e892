"""Data-quality checks on the untyped case table (Q1-Q11).

Each check is one aggregate over the frame and returns one row per
checked field (or rule) with its measures plus ``severity`` and
``message`` (both NULL when the field passes).  ``quality_report``
unions the findings of all checks and adds the score and pass/fail
rows; ``passed`` is "no error row" (errors and warnings of every check
accumulate rather than overwrite each other).

Checks that need a column which is absent are decided from the schema
when the plan is built, never by a Spark action.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions.numbers import ratio_units, round_ratio, tenths_text, to_number
from .cleaning import _present, br_date, clean_code, iso_date

def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _sev(cond: Column, level: str) -> Column:
    return F.when(cond, F.lit(level))


# Checks Q1-Q4, Q6 and Q7 are written as "parts": the aggregates they need
# (name -> Column) and the rows they emit from the 1-row aggregate.  Run
# alone, a check aggregates its own parts; the report merges every part
# into one wide aggregate so the table is scanned once for all of them.
Parts = tuple[dict, list]


def _run(df: DataFrame, parts: Parts, empty_schema: str) -> DataFrame:
    aggs, rows = parts
    if not rows:
        return _empty(df.sparkSession, empty_schema)
    stats = df.agg(*[c.alias(n) for n, c in aggs.items()])
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _count() -> dict:
    return {"_n": F.count(F.lit(1))}


# ---------------------------------------------------------------- Q1
def required_parts(df: DataFrame, fields: Sequence[str] = P.REQUIRED_FIELDS) -> Parts:
    present = _present(df, fields)
    aggs = _count() | {"req_" + f: F.count_if(F.col(f).isNull()) for f in present}
    rows = []
    for f in fields:
        if f in present:
            nulls = F.col("req_" + f)
            rows.append(F.struct(F.lit(f).alias("field"), F.lit(True).alias("present"), nulls.alias("null_count"),
                                 round_ratio(nulls, F.col("_n")).alias("null_percentage"),
                                 (nulls == 0).alias("complete"),
                                 _sev(nulls > 0, "error").alias("severity"),
                                 F.when(nulls > 0, F.concat(F.lit(f"Campo obrigatório '{f}' tem "),
                                                            tenths_text(ratio_units(nulls, F.col("_n"), 2, 1)),
                                                            F.lit("% valores nulos"))).alias("message")))
        else:
            rows.append(F.struct(F.lit(f).alias("field"), F.lit(False).alias("present"),
                                 F.lit(None).cast("bigint").alias("null_count"),
                                 F.lit(None).cast("double").alias("null_percentage"),
                                 F.lit(False).alias("complete"), F.lit("error").alias("severity"),
                                 F.lit(f"Campo obrigatório '{f}' não encontrado nos dados").alias("message")))
    return aggs, rows


def q_required(df: DataFrame, fields: Sequence[str] = P.REQUIRED_FIELDS) -> DataFrame:
    return _run(df, required_parts(df, fields), "")


# ---------------------------------------------------------------- Q2
def null_profile_parts(df: DataFrame, warn_percent: float = P.NULL_WARNING_PERCENT) -> Parts:
    aggs = _count() | {"nul_" + c: F.count_if(F.col(c).isNull()) for c in df.columns}
    rows = []
    for c in df.columns:
        n = F.col("nul_" + c)
        high = n * 100 > F.col("_n") * warn_percent
        rows.append(F.struct(F.lit(c).alias("field"), n.alias("null_count"),
                             round_ratio(n, F.col("_n")).alias("null_percentage"),
                             _sev(high, "warning").alias("severity"),
                             F.when(high, F.concat(F.lit(f"Campo '{c}' tem alta taxa de nulos: "),
                                                   tenths_text(ratio_units(n, F.col("_n"), 2, 1)), F.lit("%"))).alias("message")))
    return aggs, rows


def q_null_profile(df: DataFrame, warn_percent: float = P.NULL_WARNING_PERCENT) -> DataFrame:
    return _run(df, null_profile_parts(df, warn_percent), "")


# ---------------------------------------------------------------- Q3
def types_parts(df: DataFrame, date_fields: Sequence[str] = P.QUALITY_DATE_FIELDS,
                numeric_fields: Sequence[str] = tuple(P.NUMERIC_RANGES)) -> Parts:
    """Whole-column convertibility with each column's own date format."""
    aggs, specs = _count(), []
    for f in _present(df, date_fields):
        if isinstance(df.schema[f].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            specs.append((f, "date", F.lit(0).cast("bigint"), "valid_datetime", None))
            continue
        parse = br_date(f) if f in P.BR_DATE_COLUMNS else iso_date(f)
        aggs["typ_" + f] = F.count_if(F.col(f).isNotNull() & parse.isNull())
        specs.append((f, "date", F.col("typ_" + f), "convertible_to_date", "invalid_date_format"))
    for f in _present(df, numeric_fields):
        if isinstance(df.schema[f].dataType, T.NumericType):
            specs.append((f, "numeric", F.lit(0).cast("bigint"), "valid_numeric", None))
            continue
        aggs["typ_" + f] = F.count_if(F.col(f).isNotNull() & to_number(f).isNull())
        specs.append((f, "numeric", F.col("typ_" + f), "convertible_to_numeric", "invalid_numeric"))
    rows = []
    for f, kind, bad, ok_status, bad_status in specs:
        failed = (bad > 0) if bad_status else F.lit(False)
        msg = (f"Campo de data '{f}' não está em formato válido" if kind == "date"
               else f"Campo numérico '{f}' contém valores não numéricos")
        rows.append(F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), bad.cast("bigint").alias("invalid_count"),
                             F.when(failed, F.lit(bad_status)).otherwise(F.lit(ok_status)).alias("status"),
                             _sev(failed, "warning").alias("severity"),
                             F.when(failed, F.lit(msg)).alias("message")))
    return aggs, rows


def q_types(df: DataFrame, date_fields: Sequence[str] = P.QUALITY_DATE_FIELDS,
            numeric_fields: Sequence[str] = tuple(P.NUMERIC_RANGES)) -> DataFrame:
    return _run(df, types_parts(df, date_fields, numeric_fields),
                "field string, kind string, invalid_count bigint, status string, severity string, message string")


# ---------------------------------------------------------------- Q4
def ranges_parts(df: DataFrame, ranges: dict[str, tuple[float, float]] = P.NUMERIC_RANGES) -> Parts:
    aggs, rows = {}, []
    for f in _present(df, list(ranges)):
        lo, hi = ranges[f]
        v = to_number(f)
        aggs["rlo_" + f], aggs["rhi_" + f] = F.count_if(v < lo), F.count_if(v > hi)
        for side, bound, word in (("min", lo, "abaixo do mínimo"), ("max", hi, "acima do máximo")):
            n = F.col(("rlo_" if side == "min" else "rhi_") + f)
            rows.append(F.struct(F.lit(f).alias("field"), F.lit(side).alias("side"), F.lit(float(bound)).alias("bound"),
                                 n.alias("violations"), _sev(n > 0, "warning").alias("severity"),
                                 F.when(n > 0, F.concat(F.lit(f"Campo '{f}': "), n.cast("string"),
                                                        F.lit(f" valores {word} ({bound})"))).alias("message")))
    return aggs, rows


def q_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] = P.NUMERIC_RANGES) -> DataFrame:
    return _run(df, ranges_parts(df, ranges),
                "field string, side string, bound double, violations bigint, severity string, message string")


# ---------------------------------------------------------------- Q5
def _invalid_code(col: str, valid: Sequence[str]) -> Column:
    v = F.upper(F.trim(F.col(col).cast("string")))
    return v.isNotNull() & ~v.isin([x.upper() for x in valid])


def categorical_parts(df: DataFrame, rules: dict[str, Sequence[str]] = P.CATEGORICAL_RULES,
                      skip: Sequence[str] = tuple(P.BR_DATE_COLUMNS)) -> Parts:
    """Invalid-code counts only (the findings need no example values), as
    columns of the wide aggregate."""
    aggs, rows = {}, []
    for f in [f for f in _present(df, list(rules)) if f not in skip]:
        aggs["cat_" + f] = F.count_if(_invalid_code(f, rules[f]))
        n = F.col("cat_" + f)
        rows.append(F.struct(F.lit(f).alias("field"), n.alias("invalid_count"), _sev(n > 0, "warning").alias("severity"),
                             F.when(n > 0, F.concat(F.lit(f"Campo '{f}': "), n.cast("string"),
                                                    F.lit(" valores inválidos encontrados"))).alias("message")))
    return aggs, rows


def q_categorical(df: DataFrame, rules: dict[str, Sequence[str]] = P.CATEGORICAL_RULES,
                  skip: Sequence[str] = tuple(P.BR_DATE_COLUMNS), examples: int = P.CATEGORICAL_EXAMPLES) -> DataFrame:
    """Invalid code counts and up to ``examples`` sorted invalid values.

    The examples come from a distributed distinct of the invalid values
    followed by a per-field top-N (``WindowGroupLimit``), so a column with
    millions of distinct bad values never lands in one buffer.
    """
    from pyspark.sql import Window

    fields = [f for f in _present(df, list(rules)) if f not in skip]
    if not fields:
        return _empty(df.sparkSession, "field string, invalid_count bigint, invalid_values string, severity string, message string")
    # Only invalid (field, value) pairs leave the scan; valid codes are dropped map-side.
    pairs = []
    for f in fields:
        v = F.upper(F.trim(F.col(f).cast("string")))
        bad_v = v.isNotNull() & ~v.isin([x.upper() for x in rules[f]])
        pairs.append(F.when(bad_v, F.struct(F.lit(f).alias("field"), v.alias("value"))))
    bad = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("p.field", "p.value")
    per_value = bad.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field").orderBy("value")
    # Both branches read the same per-value aggregate (count kept), so its
    # shuffle is computed once and reused.
    top = (per_value.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= examples)
           .groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))),
                                                          lambda x: x["value"]), ", ").alias("invalid_values")))
    counts = per_value.groupBy("field").agg(F.sum("n").cast("bigint").alias("invalid_count"))
    base = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    out = (base.join(counts, "field", "left").join(top, "field", "left")
           .select("field", F.coalesce("invalid_count", F.lit(0)).cast("bigint").alias("invalid_count"), "invalid_values"))
    n = F.col("invalid_count")
    return out.select("field", "invalid_count", "invalid_values", _sev(n > 0, "warning").alias("severity"),
                      F.when(n > 0, F.concat(F.lit("Campo '"), F.col("field"), F.lit("': "), n.cast("string"),
                                             F.lit(" valores inválidos encontrados"))).alias("message"))


# ---------------------------------------------------------------- Q6
def _as_date(df: DataFrame, f: str) -> Column:
    if isinstance(df.schema[f].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(f).cast("date")
    return br_date(f) if f in P.BR_DATE_COLUMNS else iso_date(f)


def temporal_parts(df: DataFrame, pairs: Sequence[tuple[str, str]] = P.TEMPORAL_PAIRS) -> Parts:
    present = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    aggs, rows = {}, []
    for i, (a, b) in enumerate(present):
        ea, lb = _as_date(df, a), _as_date(df, b)
        both = ea.isNotNull() & lb.isNotNull()
        aggs[f"tc{i}"], aggs[f"tx{i}"] = F.count_if(both), F.count_if(both & (lb < ea))
        c, x = F.col(f"tc{i}"), F.col(f"tx{i}")
        rows.append(F.struct(
            F.lit(f"{a}_vs_{b}").alias("pair"), x.alias("inconsistent_count"), c.alias("total_comparable"),
            F.when(c > 0, round_ratio(c - x, c)).otherwise(F.lit(100.0)).alias("consistency_rate"),
            _sev(x > 0, "error").alias("severity"),
            F.when(x > 0, F.concat(F.lit("Inconsistência temporal: "), x.cast("string"),
                                   F.lit(f" registros onde '{b}' é anterior a '{a}'"))).alias("message")))
    return aggs, rows


def q_temporal(df: DataFrame, pairs: Sequence[tuple[str, str]] = P.TEMPORAL_PAIRS) -> DataFrame:
    return _run(df, temporal_parts(df, pairs),
                "pair string, inconsistent_count bigint, total_comparable bigint, consistency_rate double, severity string, message string")


# ---------------------------------------------------------------- Q7
def _code(df: DataFrame, col: str, valid: Sequence[str]) -> Column:
    return clean_code(col, valid) if col in df.columns else F.lit(None).cast("string")


def rule_icu_expr(df: DataFrame) -> Column:
    """ICU = 1 while not hospitalised (a missing HOSPITAL column counts as '2')."""
    if P.ICU_COL not in df.columns:
        return F.lit(False)
    hosp = _code(df, P.HOSP_COL, ["1", "2", "9"]) if P.HOSP_COL in df.columns else F.lit("2")
    return F.coalesce((_code(df, P.ICU_COL, ["1", "2", "9"]) == "1") & (hosp == "2"), F.lit(False))


def rule_death_symptoms_expr(df: DataFrame) -> Column:
    syms = _present(df, P.COUNTED_SYMPTOMS)
    if not syms or P.OUTCOME_COL not in df.columns:
        return F.lit(False)
    any_symptom = F.lit(False)
    for s in syms:
        any_symptom = any_symptom | F.coalesce(to_number(s) == 1, F.lit(False))
    return F.coalesce(_code(df, P.OUTCOME_COL, ["1", "2", "3", "9"]) == "2", F.lit(False)) & ~any_symptom


def rule_doses_expr(df: DataFrame) -> Column:
    """Dose 2 without dose 1; booster without both (a dose = a valid date)."""
    has = {c: (_as_date(df, c).isNotNull() if c in df.columns else F.lit(False))
           for c in ("DOSE_1_COV", "DOSE_2_COV", "DOSE_REF")}
    out = F.lit(False)
    if "DOSE_1_COV" in df.columns and "DOSE_2_COV" in df.columns:
        out = out | (~has["DOSE_1_COV"] & has["DOSE_2_COV"])
    if all(c in df.columns for c in ("DOSE_1_COV", "DOSE_2_COV", "DOSE_REF")):
        out = out | (has["DOSE_REF"] & (~has["DOSE_1_COV"] | ~has["DOSE_2_COV"]))
    return out


RULES = [
    ("uti_requires_internment", "UTI=1 requer internação hospitalar", rule_icu_expr),
    ("death_without_symptoms", "Óbito sem sintomas registrados", rule_death_symptoms_expr),
    ("vaccination_consistency", "Consistência nas doses de vacina", rule_doses_expr),
]


def rules_parts(df: DataFrame, names: Sequence[str] | None = None) -> Parts:
    rules = [r for r in RULES if names is None or r[0] in names]
    aggs, rows = {}, []
    for name, desc, fn in rules:
        aggs["rule_" + name] = F.count_if(fn(df))
        v = F.col("rule_" + name)
        rows.append(F.struct(F.lit(name).alias("rule"), F.lit(desc).alias("description"), v.alias("violations"),
                             (v == 0).alias("passed"), _sev(v > 0, "warning").alias("severity"),
                             F.when(v > 0, F.concat(F.lit(f"Regra de negócio violada: {desc} ("), v.cast("string"),
                                                    F.lit(" casos)"))).alias("message")))
    return aggs, rows


def q_rules(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return _run(df, rules_parts(df, names), "")


# ---------------------------------------------------------------- Q8
def q_outliers(df: DataFrame, field: str = P.AGE_COL, method: str = "iqr", factor: float = P.IQR_FACTOR,
               bounds: tuple[float, float] = P.PERCENTILE_BOUNDS, samples: int = P.OUTLIER_SAMPLES,
               warn_percent: float = P.OUTLIER_WARNING_PERCENT, exact: bool = True, counted: DataFrame | None = None,
               many_values: bool = False) -> DataFrame:
    """IQR or percentile-bound outliers of a numeric (or numeric-text) column.

    Quantiles are exact (linear interpolation) by default, from one map of the
    distinct values; with ``many_values`` from order statistics over range
    partitions, for columns whose values do not fit one task (this writes them
    to the shared folder).  ``exact=False`` takes ``percentile_approx``.  The bounds are a 1-row frame broadcast to the scan.  ``counted``
    are the column's values ``v`` with counts ``c`` made from ``df`` before.
    """
    v = to_number(field)
    # One scan: the counts of the distinct values give bounds, flags and samples.
    values = (df.select(v.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("c")) if counted is None
              else counted.groupBy("v").agg(F.sum("c").alias("c")))
    probs = [0.25, 0.75] if method == "iqr" else list(bounds)
    if exact and many_values:
        from ..functions.quantiles import exact_quantiles

        stats = exact_quantiles(values, probs)
    else:
        q = F.percentile("v", probs, F.col("c")) if exact else F.percentile_approx("v", probs, 100000)
        stats = values.agg(F.sum("c").alias("n"), q.alias("q"))
    if method == "iqr":
        iqr = F.col("q")[1] - F.col("q")[0]
        stats = stats.select("n", (F.col("q")[0] - iqr * factor).alias("lower_bound"), (F.col("q")[1] + iqr * factor).alias("upper_bound"))
    else:
        stats = stats.select("n", F.col("q")[0].alias("lower_bound"), F.col("q")[1].alias("upper_bound"))
    flagged = values.join(F.broadcast(stats), (F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound"))).select("v", "c")
    count = flagged.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("outlier_count"))
    sample = (flagged.orderBy("v").limit(samples)
              .agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("v", F.least("c", F.lit(samples)).cast("int"))))).alias("s"))
              .select(F.array_join(F.transform(F.slice("s", 1, samples), lambda x: x.cast("string")), ",").alias("sample_outliers")))
    j = stats.crossJoin(count).crossJoin(sample)  # one row each
    n, o = F.col("n"), F.col("outlier_count")
    high = o * 100 > n * warn_percent
    return j.where(n > 0).select(
        F.lit(field).alias("field"), F.lit(method).alias("method"), "lower_bound", "upper_bound",
        o.alias("outlier_count"), round_ratio(o, n).alias("outlier_percentage"),
        F.coalesce("sample_outliers", F.lit("")).alias("sample_outliers"),
        _sev(high, "warning").alias("severity"),
        F.when(high, F.concat(F.lit(f"Campo '{field}' tem alta taxa de outliers: "),
                              tenths_text(ratio_units(o, n, 2, 1)), F.lit("%"))).alias("message"))


# ---------------------------------------------------------------- Q9
def q_duplicates(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    from .profile import duplicate_counts

    d = duplicate_counts(df, counted=counted)
    c, k = F.col("complete_duplicates"), F.col("key_field_duplicates")
    rows = [
        F.struct(F.lit("complete").alias("kind"), c.alias("duplicates"), _sev(c > 0, "warning").alias("severity"),
                 F.when(c > 0, F.concat(F.lit("Encontradas "), c.cast("string"), F.lit(" duplicatas completas"))).alias("message")),
        F.struct(F.lit("key_fields").alias("kind"), k.alias("duplicates"), _sev(k > c, "warning").alias("severity"),
                 F.when(k > c, F.concat(F.lit("Encontradas "), k.cast("string"), F.lit(" duplicatas baseadas em campos-chave"))).alias("message")),
    ]
    return d.select("total_records", F.explode(F.array(*rows)).alias("r")).select("total_records", "r.*")


# ---------------------------------------------------------------- Q10 / Q11
_FINDING = "struct<check:string,field:string,severity:string,message:string,completeness:double,key_dups:bigint,total:bigint>"


def _groups(df: DataFrame) -> list[tuple[str, Parts, str]]:
    return [("required", required_parts(df), "field"), ("null_profile", null_profile_parts(df), "field"),
            ("types", types_parts(df), "field"), ("ranges", ranges_parts(df), "field"),
            ("categorical", categorical_parts(df), "field"),
            ("temporal", temporal_parts(df), "pair"), ("business_rule", rules_parts(df), "rule")]


def wide_parts(df: DataFrame) -> Parts:
    """The parts of Q1-Q7 together: all their counts, and all their rows."""
    aggs: dict = {}
    for _, (own, _), _ in _groups(df):
        aggs.update(own)
    return aggs, [r for _, (_, rows), _ in _groups(df) for r in rows]


def _finding_row(df: DataFrame, state=None) -> DataFrame:
    """Every check of Q1-Q9 as one row with an array ``rows`` of ``(check,
    field, severity, message, completeness, key_dups, total)``; the last three
    carry what the score needs (required-field completeness, key duplicates,
    row count).

    Q1-Q7 come from one wide aggregate (Q5 as invalid-code counts), Q8 from
    the counts of distinct values, Q9 from row hashes: three scans, however
    many of findings, score and report are read from the row.  With a
    ``quality_state.QualityState`` the scans are of its three tables, and of
    ``df`` only the columns are looked at.
    """
    none = F.lit(None)

    def finding(check: str, field: Column, severity: Column, message: Column, completeness=none, key_dups=none, total=none) -> Column:
        return F.struct(F.lit(check).alias("check"), field.alias("field"), severity.alias("severity"), message.alias("message"),
                        completeness.cast("double").alias("completeness"), key_dups.cast("bigint").alias("key_dups"),
                        total.cast("bigint").alias("total")).cast(_FINDING)

    aggs: dict = {}
    rows = []
    for check, (a, parts), key in _groups(df):
        aggs.update(a)
        for r in parts:
            comp = F.when(r.getField("present"), 100.0 - r.getField("null_percentage")) if check == "required" else none
            rows.append(finding(check, r.getField(key), r.getField("severity"), r.getField("message"), comp))
    counts = (df.agg(*[c.alias(n) for n, c in aggs.items()]) if state is None
              else state.counters.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in aggs]))
    wide = counts.select(F.array(*rows).alias("w"))
    out = q_outliers(df, counted=state and state.values).agg(F.collect_list(finding("outliers", F.col("field"), F.col("severity"), F.col("message"))).alias("o"))
    dup = q_duplicates(df, state and state.rows).agg(F.collect_list(finding(
        "duplicates", F.col("kind"), F.col("severity"), F.col("message"), none,
        F.when(F.col("kind") == "key_fields", F.col("duplicates")), F.col("total_records"))).alias("d"))
    return wide.crossJoin(out).crossJoin(dup).select(F.concat("w", "o", "d").alias("rows"))  # one row each


def findings(df: DataFrame, state=None) -> DataFrame:
    """Every finding of Q1-Q9 as ``(check, field, severity, message)``."""
    return (_finding_row(df, state).select(F.explode("rows").alias("r")).where("r.severity is not null")
            .select("r.check", "r.field", "r.severity", "r.message"))


def _score(one: DataFrame) -> DataFrame:
    """The score's columns beside ``rows``."""
    def number(keep) -> Column:
        return F.size(F.filter("rows", keep)).cast("bigint")

    req = F.filter(F.transform("rows", lambda r: r["completeness"]), lambda c: c.isNotNull())
    s = one.select("rows", number(lambda r: r["severity"] == "error").alias("errors"), number(lambda r: r["severity"] == "warning").alias("warnings"),
                   F.size(req).alias("req_n"), F.aggregate(req, F.lit(0.0), lambda t, c: t + c).alias("req_sum"),
                   F.array_max(F.transform("rows", lambda r: r["key_dups"])).alias("key_dups"),
                   F.array_max(F.transform("rows", lambda r: r["total"])).alias("total_records"))
    base = F.lit(100.0) - F.col("errors") * P.SCORE_PER_ERROR - F.col("warnings") * P.SCORE_PER_WARNING
    with_comp = F.when(F.col("req_n") > 0, base * (F.col("req_sum") / F.col("req_n") / 100.0)).otherwise(base)
    rate = F.when(F.col("total_records") > 0, F.col("key_dups") / F.col("total_records")).otherwise(F.lit(0.0))
    raw = with_comp - rate * P.SCORE_DUPLICATE_WEIGHT
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    return s.select("rows", "errors", "warnings", F.col("total_records").cast("bigint").alias("total_records"),
                    F.col("key_dups").alias("key_field_duplicates"),
                    (F.floor(clamped * 100 + 0.5) / 100.0).alias("quality_score"),
                    (F.col("errors") == 0).alias("passed"))


def quality_score(df: DataFrame, state=None) -> DataFrame:
    """Q10: 100 - 10*errors - 2*warnings, times the mean completeness of the
    required fields, minus 20 * key-duplicate rate; clamped to 0..100."""
    return _score(_finding_row(df, state)).drop("rows")


def quality_report(df: DataFrame, state=None) -> DataFrame:
    """Q11: all findings plus summary rows, one long table, exploded from the
    one finding row."""
    summary = F.array(*[F.struct(F.lit("summary").alias("check"), F.lit(name).alias("field"), F.lit(None).cast("string").alias("severity"),
                                 F.lit(None).cast("string").alias("message"), F.col(name).cast("double").alias("value"))
                        for name in ("total_records", "errors", "warnings", "quality_score", "passed")])
    found = F.transform(F.filter("rows", lambda r: r["severity"].isNotNull()), lambda r: F.struct(
        r["check"].alias("check"), r["field"].alias("field"), r["severity"].alias("severity"), r["message"].alias("message"),
        F.lit(None).cast("double").alias("value")))
    return _score(_finding_row(df, state)).select(F.explode(F.concat(found, summary)).alias("r")).select("r.*")
