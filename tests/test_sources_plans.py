"""CSV sources, sinks, the driver contract and plan shape."""

import os
import tempfile

from epispark.sources import articles as SA
from epispark.sources import csv as CSV


def _write(text: str, encoding: str = "utf-8") -> str:
    d = tempfile.mkdtemp(prefix="epispark-csv-")
    p = os.path.join(d, "data.csv")
    with open(p, "w", encoding=encoding) as f:
        f.write(text)
    return p


def test_delimiter_sniff(spark):
    assert CSV.detect_delimiter(spark, _write("A;B;C\n1;2;3\n")) == ";"
    assert CSV.detect_delimiter(spark, _write("A,B,C\n1,2,3\n")) == ","
    assert CSV.detect_delimiter(spark, "/nonexistent/file.csv") == ";"


def test_short_rows_kept_long_rows_dropped(spark):
    p = _write("DT_NOTIFIC;UTI;EXTRA\n2024-01-01;1;x\n2024-01-02;2\n2024-01-03;1;y;z\n")
    rows = CSV.scan_csv(spark, p).collect()
    assert [r.DT_NOTIFIC for r in rows] == ["2024-01-01", "2024-01-02"]
    assert rows[1].EXTRA is None


def test_scan_rows_do_not_depend_on_the_projection(spark):
    p = _write('A;B;C\n1;2;3\n4;5;6;7\n8;"x;y;z"\n9;;\n10;a;b;\n\n11\n"12";"say ""hi; you""";c\n')
    want = ["1", "8", "9", "11", "12"]
    whole = CSV.scan_csv(spark, p)
    assert [r.A for r in whole.collect()] == want
    assert [r.A for r in whole.select("A").collect()] == want
    assert [r.A for r in CSV.scan_csv(spark, p, project=["A"]).collect()] == want
    assert whole.count() == len(want) and whole.select("C").count() == len(want)
    rows = {r.A: r for r in whole.collect()}
    assert rows["8"].B == "x;y;z" and rows["8"].C is None and rows["12"].B == 'say "hi; you"'


def test_api_and_feed_records_are_mapped(spark):
    api = spark.createDataFrame([(1, "t", "u", "d", "p", ("n",)), (2, "t2", None, None, None, (None,)), (3, "", "u", "d", "p", ("n",))],
                                "article_id long, title string, url string, description string, publishedAt string, source struct<name string>")
    rows = SA.api_records(api).collect()
    assert [(r.article_id, r.link, r.summary, r.published, r.source, r.source_type) for r in rows] == [
        (1, "u", "d", "p", "n", "news_api"), (2, "", "", None, "News API", "news_api")]
    feed = spark.createDataFrame([(4, "t", None, "l", "p", "feed")], "article_id long, title string, summary string, link string, published string, source string")
    r = SA.feed_entries(feed).first()
    assert (r.summary, r.link, r.source_type) == ("", "l", "rss")


def test_projection_and_latin1(spark):
    p = _write("DT_NOTIFIC;NM_PACIENT;UTI\n2024-01-01;José;1\n", encoding="latin-1")
    df = CSV.scan_csv(spark, p, encoding="ISO-8859-1", project=["DT_NOTIFIC", "UTI", "SG_UF_NOT"])
    assert df.columns == ["DT_NOTIFIC", "UTI"]
    full = CSV.scan_csv(spark, p, encoding="ISO-8859-1")
    assert full.first().NM_PACIENT == "José"


def test_static_fallback_when_api_empty(spark):
    empty = spark.createDataFrame([], "article_id long, title string, description string, url string, publishedAt date, source struct<name string>")
    out = SA.with_fallback(SA.api_records(empty), spark, "2024-03-31")
    rows = out.collect()
    assert len(rows) == 7 and {r.source_type for r in rows} == {"fallback"}


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 4
    assert set(E.oracle_sql()) <= set(E.queries())
    from epispark.plans.catalog import QUERIES

    assert set(QUERIES) <= set(E.oracle_sql())


def test_plan_has_no_python_and_one_case_scan(spark):
    from epispark.plans.catalog import QUERIES

    df = QUERIES["metrics_bundle"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # all four rates come from one scan of the window; newest date and row count are subqueries
    main = plan.split("Subqueries")[0]
    assert sum("FileScan parquet" in line and "ReadSchema: struct<>" not in line for line in main.split("\n")) <= 1 + main.count("Subquery scalar")


def test_window_filter_prunes_partitions(spark):
    from epispark.plans.catalog import QUERIES

    df = QUERIES["filter_date_range"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ANO" in plan or "PartitionFilters: [((" in plan


def test_load_window_and_fallback_modes(spark):
    from epispark.sources import loader as L

    raw = spark.createDataFrame([("2001-05-01", "1.0", "30"), ("2001-06-02", "2", "abc"), ("1999-12-31", "9", "5")],
                                "DT_NOTIFIC string, UTI string, NU_IDADE_N string")
    w = L.load_window(raw, "2001-01-01", "2001-06-01").collect()
    assert [(r.UTI, r.NU_IDADE_N) for r in w] == [("1", 30.0)]
    recent = L.load_with_fallback(raw, "2001-06-01", "2001-06-01").collect()
    assert {r.mode for r in recent} == {"recent"} and len(recent) == 1
    hist = L.load_with_fallback(raw, "1990-06-01", "2001-06-01").collect()
    assert {r.mode for r in hist} == {"historical"} and len(hist) == 1


def test_sensitive_name_test_is_case_insensitive(spark):
    from epispark.operators import privacy as G

    df = spark.createDataFrame([(1, 2, 3)], "nu_notific int, DT_Nasc int, UTI int")
    assert G.sensitive_columns(df) == ["nu_notific", "DT_Nasc"]


def test_quality_report_scan_budget(spark):
    from epispark.operators import quality as Q
    from epispark.sources import fixtures as FX

    df = Q.quality_report(FX.raw_cases(spark, "/root/testdata/sf0.001"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # one wide aggregate, the distinct values, the row hashes; the adaptive planner
    # sometimes runs the exchange of the distinct values twice instead of reusing it
    assert plan.count("FileScan parquet") <= 4
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_rates_and_series_read_the_window_only(spark):
    """Over the case table; the registered queries read the rollup instead."""
    from epispark.operators import metrics as M, series as S
    from epispark.plans.catalog import QUERIES
    from epispark.sources import fixtures as FX

    cases, day = FX.cases(spark, "/root/testdata/sf0.001"), "2001-06-01"
    frames = {f.__name__: f(cases, day, now=day) for f in (M.case_increase_rate, M.mortality_rate, M.icu_rate, M.vaccination_rate, M.dose_breakdown, M.metrics_bundle)}
    frames |= {"monthly_counts": S.monthly_counts(cases, day, 365), "filter_plausible_date": QUERIES["filter_plausible_date"](spark, "/root/testdata/sf0.001")}
    for key, frame in frames.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "DT_NOTIFIC" in line.split("ReadSchema")[-1]]
        assert scans and all("PartitionFilters: []" not in line for line in scans), key


def test_registered_rates_read_the_rollup_once(spark):
    from epispark.plans.catalog import QUERIES

    for key in ("case_increase_rate", "mortality_rate", "icu_rate", "vaccination_rate", "dose_breakdown", "metrics_bundle", "monthly_counts", "daily_counts"):
        plan = QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "ubquery" not in plan and "NestedLoop" not in plan and "/rollup-" in plan, key


def test_rollup_gives_the_rates_of_the_cases(spark):
    from epispark.operators import metrics as M, rollup as RU, series as S
    from epispark.sources import fixtures as FX

    cases = FX.cases(spark, "/root/testdata/sf0.001")
    for df in (cases, cases.drop("DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC"), cases.limit(0)):
        daily = RU.daily_rollup(df)
        for day, now in (("2001-06-01", "2001-06-01"), ("2001-06-01", "2009-01-01"), ("1990-01-01", None)):
            for rate in (M.case_increase_rate, M.mortality_rate, M.icu_rate, M.vaccination_rate, M.dose_breakdown, M.metrics_bundle):
                assert sorted(map(str, rate(daily, day, now=now).collect())) == sorted(map(str, rate(df, day, now=now).collect())), rate.__name__
            assert S.monthly_counts(daily, day).collect() == S.monthly_counts(df, day).collect()
            assert sorted(S.daily_counts(daily, day).collect()) == sorted(S.daily_counts(df, day).collect())
        assert M.adjust_reference_date(daily, "2001-06-01", "2009-01-01").collect() == M.adjust_reference_date(df, "2001-06-01", "2009-01-01").collect()


def test_rollup_refreshes_single_years(spark, tmp_path):
    import glob

    from epispark.operators import rollup as RU
    from pyspark.sql import functions as F

    def cases(rows):
        return spark.createDataFrame(rows, "DT_NOTIFIC string, TEVE_OBITO int, TEVE_UTI int, DOSE_1_COV string").withColumn("DT_NOTIFIC", F.to_date("DT_NOTIFIC"))

    old = [("1999-05-01", 1, 0, None), ("2000-02-02", 0, 1, "x"), ("2001-03-03", 0, 0, None), (None, 1, 1, None)]
    path = str(tmp_path / "rollup")
    RU.save_rollup(RU.daily_rollup(cases(old)), path)
    before = set(glob.glob(path + "/ANO=1999/*.parquet"))
    new = [old[0], old[0], ("2000-02-02", 0, 1, "x"), ("2000-02-02", 1, 1, None)]  # 1999 changed too, but is not refreshed
    RU.refresh_rollup(cases(new), path, [2000, 2001])
    rows = {str(r.day): (r.cases, r.deaths, r.icu, r.vaccinated) for r in RU.load_rollup(spark, path).collect()}
    assert rows == {"1999-05-01": (1, 1, 0, 0), "2000-02-02": (2, 1, 2, 1)}  # 2001 lost its only case
    assert set(glob.glob(path + "/ANO=1999/*.parquet")) == before


# ------------------------------------------------------- records of CSV files
def _python_records(text: str, sep: str) -> list[list[str]]:
    """Rows of one file by the standard library's reader."""
    import csv
    import io

    return [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if row]


def test_quoted_line_break_and_quoted_header_separator(spark):
    p = _write('x;y\n"a\nb";2\n3;4\n')
    df = CSV.scan_csv(spark, p)
    assert sorted(map(tuple, df.collect())) == [("3", "4"), ("a\nb", "2")]
    assert df.count() == 2 and sorted(r.y for r in CSV.scan_csv(spark, p, project=["y"]).collect()) == ["2", "4"]
    q = _write('"x;y";z\n1;2\n')
    assert CSV.header_columns(spark, q, ";") == ["x;y", "z"]
    assert [tuple(r) for r in CSV.scan_csv(spark, q, sep=";").collect()] == [("1", "2")]
    h = _write('"a\nb";c\n\n1;"2\n\n3"\n')
    assert CSV.header_columns(spark, h, ";") == ["a\nb", "c"]
    assert [tuple(r) for r in CSV.scan_csv(spark, h, sep=";").collect()] == [("1", "2\n\n3")]


def test_quote_inside_a_field_and_open_quote_at_the_end(spark):
    p = _write('x;y\n12" pipe;a\n"p ""q"" r";"s;t"\nu "v;w" z\n5;"open\n6;7\n8;9\n')
    got = sorted(map(tuple, CSV.scan_csv(spark, p).collect()))
    assert ('12" pipe', "a") in got and ('p "q" r', "s;t") in got and ('u "v', 'w" z') in got
    assert ("6", "7") in got and ("8", "9") in got and len(got) == 6


def test_records_across_many_splits(spark, tmp_path):
    """Random files cut into splits of a few bytes against the standard
    library's reader, with fields that cover several splits."""
    import random

    rnd = random.Random(3)
    field = lambda: rnd.choice([str(rnd.randint(0, 99)), "", "plain", '"q"', '"a;b"', '"l1\nl2"', '"say ""hi"";\n\n end"', '"' + "long line\n" * rnd.randint(1, 40) + '"', 'in"ch'])
    want = []
    for f in range(4):
        rows = [";".join(field() for _ in range(rnd.choice([2, 2, 2, 1, 3]))) for _ in range(rnd.randint(30, 120))]
        text = "a;b\n" + "".join(r + "\n" for r in rows)
        (tmp_path / f"part{f}.csv").write_text(text, encoding="utf-8")
        want += [(r + [""])[:2] for r in _python_records(text, ";")[1:] if len(r) <= 2]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "700", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size != old else "4194304")
            got = [[x or "" for x in r] for r in CSV.scan_csv(spark, str(tmp_path), sep=";", columns=["a", "b"]).collect()]
            assert sorted(got) == sorted(want), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304")


def test_very_long_quoted_field(spark):
    p = _write('x;y\n"' + 'a "" b;\n' * 40_000 + '";2\n' + '"' + "z" * 300_000 + '";3\n')
    got = sorted(CSV.scan_csv(spark, p).collect(), key=lambda r: r.y)
    assert got[0].x == 'a " b;\n' * 40_000 and got[1].x == "z" * 300_000
