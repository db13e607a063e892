"""P1-P15 on literal micro-fixtures (one row per edge case)."""

import datetime as dt

from pyspark.sql import functions as F

from epispark.operators import cleaning as C
from epispark import params as P


def _raw(spark, rows, cols):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def test_dates_iso_and_brazilian(spark):
    df = _raw(spark, [("2024-1-5", "05/01/2024"), ("2024-01-05", "5/1/2024"), ("32/13/2024", "32/13/2024"),
                      ("2024-01-05 10:00", " 05/01/2024"), (None, None)], ["DT_NOTIFIC", "DOSE_1_COV"])
    out = C.parse_dates(df).collect()
    d = dt.date(2024, 1, 5)
    assert [r.DT_NOTIFIC for r in out] == [d, d, None, None, None]
    assert [r.DOSE_1_COV for r in out] == [d, d, None, None, None]


def test_codes_strip_point_zero_and_whitelist(spark):
    df = _raw(spark, [("1.0", "M"), (" 2 ", "X"), ("5", "F"), (None, None), ("9", "I")], ["UTI", "CS_SEXO"])
    out = C.clean_codes(df).collect()
    assert [r.UTI for r in out] == ["1", "2", None, None, "9"]
    assert [r.CS_SEXO for r in out] == ["M", None, "F", None, "I"]


def test_age_range_and_coercion(spark):
    df = _raw(spark, [("25",), ("-5",), ("150",), ("abc",), ("120",), ("0",)], ["NU_IDADE_N"])
    assert [r.NU_IDADE_N for r in C.clean_age(df).collect()] == [25.0, None, None, None, 120.0, 0.0]


def test_age_band_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 12.0, 12.5, 18.0, 60.0, 61.0, 120.0, 121.0, None]], "NU_IDADE_N double")
    got = [r[0] for r in df.select(C.age_band_expr()).collect()]
    assert got == ["Criança", "Criança", "Adolescente", "Adolescente", "Adulto", "Idoso", "Idoso", None, None]


def test_vaccination_cascade_later_rule_wins(spark):
    d = dt.date(2021, 1, 1)
    rows = [(None, None, None, None, None), (d, None, None, None, None), (d, d, None, None, None),
            (d, d, d, None, None), (d, d, d, d, None), (None, None, None, None, d), (d, None, d, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} date" for c in P.STATUS_DOSE_COLUMNS))
    got = [r[0] for r in df.select(C.vaccination_status_expr(df.columns)).collect()]
    assert got == [P.VAX_NONE, P.VAX_ONE, P.VAX_TWO, P.VAX_BOOSTER, P.VAX_EXTRA, P.VAX_EXTRA, P.VAX_BOOSTER]


def test_vaccination_without_dose_columns(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert df.select(C.vaccination_status_expr(df.columns)).first()[0] == P.VAX_UNKNOWN


def test_derived_flags_and_counts(spark):
    df = _raw(spark, [("2024-03-01", "2", "1", "70", "1", "1", "2"), ("2024-03-02", None, None, "1", "9", None, "1")],
              ["DT_NOTIFIC", "EVOLUCAO", "UTI", "NU_IDADE_N", "FEBRE", "TOSSE", "VOMITO"])
    out = C.process(df).collect()
    assert (out[0].TEVE_OBITO, out[0].TEVE_UTI, out[0].CASO_GRAVE) == (1, 1, 1)
    assert (out[1].TEVE_OBITO, out[1].TEVE_UTI) == (0, 0)
    assert out[0].EVOLUCAO_SIMPLES == "Óbito" and out[1].EVOLUCAO_SIMPLES == "Ignorado"
    assert out[0].NUM_SINTOMAS == 2 and out[1].NUM_SINTOMAS == 1
    assert (out[0].GRUPO_RISCO_IDADE, out[1].GRUPO_RISCO_IDADE) == ("Alto", "Alto")
    assert (out[0].ANO, out[0].MES, out[0].SEMANA_EPI) == (2024, 3, 9)


def test_anonymised_order_changes_bands(spark):
    # 13 floors to 10 -> child band; 61 floors to 60 -> adult band
    df = spark.createDataFrame([(13.0,), (61.0,), (3.0,)], "NU_IDADE_N double")
    anon = df.withColumn("NU_IDADE_N", C.anonymised_age_expr())
    got = anon.select(C.age_band_expr(), C.age_risk_expr()).collect()
    assert [tuple(r) for r in got] == [("Criança", "Baixo"), ("Adulto", "Alto"), ("Criança", "Alto")]


def test_decode_and_age_from_birth(spark):
    df = spark.createDataFrame([("M", "1", dt.date(2000, 6, 2))], "CS_SEXO string, UTI string, DT_NASC date")
    out = C.decode_codes(df).select("CS_SEXO_DESC", "UTI_DESC", C.age_from_birth_expr("DT_NASC", "2010-06-01").alias("age")).first()
    assert tuple(out) == ("Masculino", "Sim", 10)  # 3651 days // 365


def test_numeric_text_takes_no_suffix(spark):
    from epispark.functions.numbers import to_number

    rows = spark.createDataFrame([(x,) for x in ("12", " 3.5 ", "12d", "12f", "1e2", ".5", "-4", "", "abc", "0x1", None)], "v string")
    assert [r[0] for r in rows.select(to_number("v")).collect()] == [12.0, 3.5, None, None, 100.0, 0.5, -4.0, None, None, None, None]
