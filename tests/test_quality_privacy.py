"""Quality checks on the problematic rows and privacy guardrails."""

from pyspark.sql import functions as F

from epispark import params as P
from epispark.functions import text as TX
from epispark.operators import privacy as G
from epispark.operators import quality as Q


def _problem_rows(spark):
    # DT_NOTIFIC / age / sex / outcome / ICU with bad values in each column
    rows = [("01/01/2024", "25", "M", "1", "1"), ("32/13/2024", "-5", "F", "2", "2"), ("", "200", "X", "8", "5")]
    return spark.createDataFrame(rows, "DT_NOTIFIC string, NU_IDADE_N string, CS_SEXO string, EVOLUCAO string, UTI string")


def test_ranges_and_categories(spark):
    df = _problem_rows(spark)
    r = {row.side: row.violations for row in Q.q_ranges(df).collect()}
    assert r == {"min": 1, "max": 1}
    c = {row.field: (row.invalid_count, row.invalid_values) for row in Q.q_categorical(df).collect()}
    assert c["CS_SEXO"] == (1, "X") and c["EVOLUCAO"] == (1, "8") and c["UTI"] == (1, "5")


def test_required_missing_column_is_error(spark):
    rows = {r.field: r for r in Q.q_required(_problem_rows(spark)).collect()}
    assert rows["NU_NOTIFIC"].severity == "error" and not rows["NU_NOTIFIC"].present
    assert rows["DT_NOTIFIC"].null_count == 0


def test_report_accumulates_and_fails_on_error(spark):
    rep = Q.quality_report(_problem_rows(spark)).collect()
    summary = {r.field: r.value for r in rep if r.check == "summary"}
    assert summary["passed"] == 0.0 and summary["errors"] >= 1 and summary["warnings"] >= 4
    assert 0.0 <= summary["quality_score"] <= 100.0


def test_temporal_pairs_and_rules(spark):
    df = spark.createDataFrame([("2024-01-10", "2024-01-05", "1", "2", "2"), ("2024-01-10", "2024-01-12", "1", "1", "1")],
                               "DT_NOTIFIC string, DT_EVOLUCA string, UTI string, HOSPITAL string, EVOLUCAO string")
    t = Q.q_temporal(df).first()
    assert (t.inconsistent_count, t.total_comparable, t.consistency_rate) == (1, 2, 50.0)
    rules = {r.rule: r.violations for r in Q.q_rules(df).collect()}
    assert rules["uti_requires_internment"] == 1 and rules["death_without_symptoms"] == 0


def test_outliers_iqr_exact(spark):
    df = spark.createDataFrame([(str(x),) for x in [1, 2, 3, 4, 100]], "NU_IDADE_N string")
    o = Q.q_outliers(df).first()
    assert (o.lower_bound, o.upper_bound, o.outlier_count, o.sample_outliers) == (-1.0, 7.0, 1, "100.0")


def test_redaction_exact_strings(spark):
    df = spark.createDataFrame([("Paciente CPF 123.456.789-00 internado",), ("Contato: (11) 99999-9999",),
                                ("Email: paciente@example.com",)], "t string")
    out = [r[0] for r in df.select(TX.redact("t")).collect()]
    assert out == ["Paciente CPF [CPF removido] internado", "Contato: [telefone removido]", "Email: [email removido]"]
    again = [r[0] for r in df.select(TX.redact(TX.redact("t"))).collect()]
    assert again == out
    assert df.select(TX.redact("t").alias("t")).where(TX.pii_hit("t")).count() == 0


def test_redact_frame_nested(spark):
    df = spark.sql("SELECT 'Ana' AS nome_paciente, named_struct('email', 'a@b.com', 'note', 'CPF 123.456.789-00') AS d, "
                   "array('tel (11) 99999-9999') AS notes, 7 AS n")
    r = G.redact_frame(df).first()
    assert r.nome_paciente == P.REDACTED_FIELD_TEXT
    assert r.d.email == P.REDACTED_FIELD_TEXT and r.d.note == "CPF [CPF removido]"
    assert r.notes == ["tel [telefone removido]"] and r.n == 7


def test_anonymise_drops_and_generalises(spark):
    df = spark.createDataFrame([("1", "123", "SP", 37.0, "x")], "NU_NOTIFIC string, CO_MUN_NOT string, SG_UF_NOT string, NU_IDADE_N double, CPF string")
    out = G.anonymise_cases(df)
    assert set(out.columns) == {"SG_UF_NOT", "NU_IDADE_N", "FAIXA_ETARIA"}
    assert tuple(out.first()) == ("SP", 35.0, "19-60")


def test_article_filter_and_mask(spark):
    df = spark.createDataFrame([("Fake News sobre vacina", "x", "blog"), ("Vacina", "ok", "g1.com"), ("milagre", "", "blog")],
                               "title string, summary string, source string")
    got = [r[0] for r in df.select(G.article_appropriate_expr()).collect()]
    assert got == [False, True, False]
    masked = df.select(TX.mask("title")).first()[0]
    assert masked == "[conteúdo filtrado] sobre vacina"


def test_fingerprint_deterministic(spark):
    df = spark.createDataFrame([("2024-03-31", 4)], "d string, n int")
    a = df.select(G.fingerprint_expr(F.col("d"), F.col("n"))).first()[0]
    b = df.select(G.fingerprint_expr(F.col("d"), F.col("n"))).first()[0]
    assert a == b and a.startswith("SRAG-") and len(a) == 21


def test_quality_run_history(spark):
    import tempfile

    from epispark.sources import sinks as SK

    path = tempfile.mkdtemp(prefix="epispark-qhist-") + "/history"
    rep = Q.quality_report(_problem_rows(spark))
    SK.append_quality_run(rep, path, "run-1", "2024-03-31 10:00:00")
    SK.append_quality_run(rep, path, "run-2", "2024-04-01 10:00:00")
    c = SK.quality_run_counters(spark, path).first()
    assert (c.total_validations, c.passed_validations, c.failed_validations) == (2, 0, 2)
    assert c.warnings_generated >= 8


def test_redaction_and_leak_check_reach_maps_and_nested_values(spark):
    df = spark.sql("""select 1 as id, map('CPF_x', '111.222.333-44', 'obs', 'mail a@b.com') as m, map('telefone', 5, 'n', 6) as n,
                      array(named_struct('nota', '(11) 99999-9999', 'k', map('a', array('c@d.org')))) as deep""")
    before = {r.column: (r.cpf_hits, r.phone_hits, r.email_hits) for r in G.pii_scan(df).collect()}
    assert before == {"m": (1, 0, 1), "n": (0, 0, 0), "deep": (0, 1, 1)}
    out = G.redact_frame(df)
    r = out.first()
    assert r.m["CPF_x"] == P.REDACTED_FIELD_TEXT and "a@b.com" not in r.m["obs"]
    assert r.n == {"telefone": None, "n": 6}
    assert "99999" not in r.deep[0].nota and "c@d.org" not in r.deep[0].k["a"][0]
    assert {(r.cpf_hits, r.phone_hits, r.email_hits) for r in G.pii_scan(out).collect()} == {(0, 0, 0)}


def test_quality_state_gives_the_report_of_the_rows(spark, tmp_path):
    from epispark.operators import quality_state as QS
    from epispark.sources import fixtures as FX

    for df in (_problem_rows(spark), FX.raw_cases(spark, "/root/testdata/sf0.001"), _problem_rows(spark).limit(0)):
        state = QS.quality_state(df)
        for f in (Q.quality_report, Q.quality_score, Q.findings):
            assert sorted(map(str, f(df, state).collect())) == sorted(map(str, f(df).collect()))


def test_quality_state_refreshes_single_batches(spark, tmp_path):
    import glob

    from epispark.operators import quality_state as QS
    from epispark.sources import fixtures as FX
    from pyspark.sql import functions as F

    df, path = FX.raw_cases(spark, "/root/testdata/sf0.001").coalesce(2), str(tmp_path / "state")
    changed = df.withColumn("UTI", F.when(F.col("DT_NOTIFIC").startswith("1997"), F.lit("7")).otherwise(F.col("UTI")))
    QS.save_state(QS.quality_state(df), path)
    files = lambda: {f for f in glob.glob(path + "/*/*/*.parquet") if "_batch=1997" not in f}
    before = files()
    QS.refresh_state(changed, path, ["1997"])
    assert files() == before
    state = QS.load_state(spark, path)
    report = Q.quality_report(changed, state)
    assert sorted(map(str, report.collect())) == sorted(map(str, Q.quality_report(changed).collect()))
    plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") <= 4 and "raw_cases" not in plan
