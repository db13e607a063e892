"""Code paths chosen for scale, checked against brute force on small data."""

import random

from pyspark.sql import functions as F

from epispark.functions.ranking import global_rank
from epispark.functions.rows import keep_if
from epispark.operators import profile as A


def _hot_cases(spark, n=300):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        if i % 3 == 0:  # one key holds a third of all rows
            key = ("2024-01-01", "100001", 30.0, "F")
        else:
            key = (f"2024-01-{rnd.randint(1, 9):02d}", str(100000 + rnd.randint(0, 4)), float(rnd.randint(0, 3)), rnd.choice("MF"))
        rows.append((str(rnd.randint(0, 50)),) + key + (rnd.choice(["1", "2", None]),))
    schema = "NU_NOTIFIC string, DT_NOTIFIC string, CO_MUN_NOT string, NU_IDADE_N double, CS_SEXO string, UTI string"
    return spark.createDataFrame(rows, schema), rows


def test_dedupe_hot_key_matches_brute_force(spark):
    df, rows = _hot_cases(spark)
    out = {tuple(r) for r in A.dedupe_cases(df).collect()}
    keyed: dict = {}
    for r in rows:
        k = (r[1], r[2], r[3], r[4])
        rank = tuple((v is not None, v) for v in (r[0], r[5]))  # nulls first, then value
        if k not in keyed or rank < keyed[k][0]:
            keyed[k] = (rank, r)
    assert out == {v[1] for v in keyed.values()}


def test_duplicate_counts_match_brute_force(spark):
    df, rows = _hot_cases(spark)
    df = df.withColumnRenamed("CO_MUN_NOT", "SG_UF_NOT")
    r = A.duplicate_counts(df).first()
    assert r.total_records == len(rows)
    assert r.complete_duplicates == len(rows) - len(set(rows))
    keys = {(x[1], x[2], x[3], x[4]) for x in rows}
    assert r.key_field_duplicates == len(rows) - len(keys) and r.unique_records == len(keys)


def test_keep_if_equals_where_with_nulls(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "id int, ok boolean")
    assert sorted(r.id for r in keep_if(df, F.col("ok")).collect()) == [1, 4]
    assert keep_if(df, F.col("ok")).columns == ["id", "ok"]
    assert keep_if(df, F.col("ok")).count() == df.where("ok").count()


def test_global_rank_many_partitions_with_ties(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score int")
    ranked = global_rank(df, [F.desc("score"), F.asc("id")], partitions=13).collect()
    expect = sorted(rows, key=lambda t: (-t[1], t[0]))
    got = sorted(ranked, key=lambda r: r["rank"])
    assert [(r.id, r.score) for r in got] == expect
    assert [r["rank"] for r in got] == list(range(1, 501))


def test_global_rank_of_a_wide_frame_without_exchange_reuse(spark):
    wide = spark.range(300_000).select(F.col("id"), (F.hash("id") % 7).alias("score"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"),
                                       F.repeat(F.lit("summary "), 5).alias("summary"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        r = global_rank(wide, [F.desc("score"), F.asc("id")], partitions=16).agg(F.countDistinct("rank").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert (r.n, r.lo, r.hi) == (300_000, 1, 300_000)


def test_exact_quantiles_by_ranges(spark):
    import random

    import numpy as np

    from epispark.functions.quantiles import exact_quantiles

    rnd = random.Random(4)
    for n, kinds in ((0, 1), (1, 1), (2, 2), (5000, 40), (5000, 10 ** 6)):
        values = [rnd.gauss(0, 1) * 10 ** rnd.randint(-3, 6) if kinds > 100 else float(rnd.randrange(kinds)) for _ in range(n)]
        counted = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count("*").alias("c"))
        probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
        got = exact_quantiles(counted, probs, partitions=7).collect()
        assert len(got) == 1
        if n:
            assert got[0].n == n and np.allclose(got[0].q, np.quantile(values, probs), rtol=1e-12, atol=1e-9)
            assert got[0].q == counted.agg(F.percentile("v", probs, F.col("c"))).first()[0]
        else:
            assert got[0].n is None and got[0].q is None


def test_outliers_of_many_values_equal_those_of_the_map(spark):
    from epispark.operators import quality as Q

    df = spark.createDataFrame([(str(i * 7 % 1001 - 20 if i % 50 else i * 1000),) for i in range(2000)] + [(None,), ("x",)], "NU_IDADE_N string")
    for method in ("iqr", "percentile"):
        assert Q.q_outliers(df, method=method, many_values=True).collect() == Q.q_outliers(df, method=method).collect()
    assert Q.q_outliers(df.limit(0), many_values=True).collect() == Q.q_outliers(df.limit(0)).collect() == []


def _base_tables(spark, folder):
    """Small base tables with null and repeated keys, one file each."""
    import datetime as dt

    day = lambda i: dt.datetime(2000, 1, 1) + dt.timedelta(days=37 * i)
    tables = {
        "nation": ([(1, "A"), (2, "B"), (None, "C")], "n_nationkey int, n_name string"),
        "customer": ([(i if i % 9 else None, i % 3 or None) for i in range(40)] + [(3, 1), (3, 2)], "c_custkey long, c_nationkey int"),
        "orders": ([(i if i % 11 else None, i % 45, day(i)) for i in range(90)] + [(5, 4, None), (6, None, day(1))], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(i % 97 if i % 13 else None, i % 211 if i % 8 else None, i % 10, i % 7 + 1, float(i % 50), (i % 11) / 100, "RAN"[i % 3]) for i in range(600)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return list(tables)


def test_raw_cases_shuffle_narrow_rows_only(spark, tmp_path):
    """The joins in another order give the rows of the SQL; what is shuffled
    are columns of the tables, also where a table would fit a broadcast."""
    from collections import Counter

    from epispark.sources import fixtures as FX

    names = _base_tables(spark, tmp_path)
    got = FX.raw_cases_query(spark, str(tmp_path))
    want = spark.sql(FX.RAW_CASES_SQL, **{n: FX.table(spark, str(tmp_path), n) for n in names})
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.schema == want.schema and got.count() > 300
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [l_orderkey" in plan


def test_landed_cases_are_not_shuffled_as_strings(spark, tmp_path, monkeypatch):
    """The raw cases are written as the join deals them, the cases are
    shuffled without the derived columns and come out as ``process`` makes
    them."""
    from collections import Counter

    from pyspark.sql.classic.dataframe import DataFrame

    from epispark.operators.cleaning import process
    from epispark.sources import fixtures as FX

    _base_tables(spark, tmp_path)
    moved, hint = [], DataFrame.hint
    monkeypatch.setattr(DataFrame, "hint", lambda self, name, *a: (moved.append((name, self.columns)), hint(self, name, *a))[1])
    got = FX.cases(spark, str(tmp_path))
    wide = [c for name, c in moved if name == "rebalance"]
    assert len(wide) == 1 and "FAIXA_ETARIA" not in wide[0] and "STATUS_VACINAL_COVID" not in wide[0]
    want = process(FX.raw_cases(spark, str(tmp_path))).select(*got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and dict(got.dtypes) == dict(want.dtypes)


def test_csv_lines_are_not_shuffled_for_a_few_broken_records(spark, tmp_path, monkeypatch):
    from epispark.sources import csv as CSV

    path = tmp_path / "broken.csv"
    path.write_text("a;b\n" + "".join(f'{i};"x\n\ny {i}"\n' if i % 50 == 0 else f"{i};z\n" for i in range(400)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = CSV.records(spark, str(path), ";")
        plan = few._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(CSV, "MOST_PLACES", 0)
        many = CSV.records(spark, str(path), ";")
        assert "SortMergeJoin" in many._jdf.queryExecution().sparkPlan().toString()
        assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 401
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_quality_state_shuffles_its_hashes_once(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from epispark.operators import quality_state as QS

    df = spark.createDataFrame([(str(i % 30), f"{2000 + i % 3}-01-01", str(i % 90)) for i in range(120)], "NU_NOTIFIC string, DT_NOTIFIC string, NU_IDADE_N string")
    moved, hint = [], DataFrame.hint
    monkeypatch.setattr(DataFrame, "hint", lambda self, name, *a: (moved.append(name), hint(self, name, *a))[1])
    QS.save_state(QS.quality_state(df), str(tmp_path / "state"))
    assert moved == []
    rows = QS.load_state(spark, str(tmp_path / "state")).rows
    assert rows.agg({"n": "sum"}).first()[0] == 120 and rows.select("_batch").distinct().count() == 3
