"""The rate bundle against a plain pandas computation of the same
definitions on the landed sf0.001 case table (independent of the SQL oracle)."""

import datetime as dt

from epispark.operators import metrics as M
from epispark.sources import fixtures as FX

SMOKE = "/root/testdata/sf0.001"


def _half_up(n: int, d: int) -> float:
    return 0.0 if d == 0 else (2 * abs(n) * 10000 + d) // (2 * d) / 100.0 * (1 if n >= 0 else -1)


def test_bundle_matches_pandas(spark):
    pdf = FX.cases(spark, SMOKE).select("DT_NOTIFIC", "TEVE_OBITO", "TEVE_UTI", "DOSE_1_COV", "DOSE_2_COV",
                                        "DOSE_REF", "DOSE_2REF", "DOSE_ADIC").toPandas()
    ref = dt.date(2001, 6, 1)
    d = pdf["DT_NOTIFIC"]

    def win(lo, hi=0):
        return (d >= ref - dt.timedelta(days=lo)) & (d <= ref - dt.timedelta(days=hi))

    vacc = pdf[["DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC"]].notna().any(axis=1)
    cur, prev = int(win(30).sum()), int(win(60, 30).sum())
    expect = {
        "case_increase_rate": (0.0 if cur == 0 else 100.0) if prev == 0 else _half_up(cur - prev, prev),
        "mortality_rate": _half_up(int(pdf.loc[win(90), "TEVE_OBITO"].sum()), int(win(90).sum())),
        "icu_occupancy_rate": _half_up(int(pdf.loc[win(30), "TEVE_UTI"].sum()), int(win(30).sum())),
        "vaccination_rate": _half_up(int((vacc & win(90)).sum()), int(win(90).sum())),
    }
    got = {r.metric: r.rate for r in M.metrics_bundle(FX.cases(spark, SMOKE), "2001-06-01", now="2001-06-01").collect()}
    assert got == expect


def test_relevance_and_context_match_python(spark):
    from epispark import params as P
    from epispark.operators import news as N

    arts = FX.articles(spark, SMOKE)
    rows = arts.select("article_id", "title", "summary").collect()
    text = {r.article_id: f"{(r.title or '').lower()} {(r.summary or '').lower()}" for r in rows}
    score = {k: sum(1 for w in P.RELEVANCE_KEYWORDS if w in t) for k, t in text.items()}
    expect = {k: v for k, v in score.items() if v >= 1}
    got = {r.article_id: r.relevance_score for r in N.article_relevance(arts).collect()}
    assert got == expect

    kept = [text[k] for k in expect]
    total = 0
    for words in P.CONTEXT_KEYWORDS.values():
        mentions = sum(1 for w in words if any(w in t for t in kept))
        total += min(mentions * 30, 250)
    total = min(total + min(len(kept) * 15, 200), 1000)
    ctx = N.context_score(N.article_relevance(arts)).first()
    assert ctx.context_score == total / 100.0 and ctx.articles == len(kept)


def test_quality_counts_match_pandas(spark):
    from epispark.operators import quality as Q

    raw = FX.raw_cases(spark, SMOKE)
    pdf = raw.toPandas()
    nulls = {r.field: r.null_count for r in Q.q_null_profile(raw).collect()}
    assert nulls == {c: int(pdf[c].isna().sum()) for c in pdf.columns}
    dup = {r.kind: r.duplicates for r in Q.q_duplicates(raw).collect()}
    keys = ["DT_NOTIFIC", "SG_UF_NOT", "NU_IDADE_N", "CS_SEXO"]
    assert dup["complete"] == int(pdf.duplicated().sum())
    assert dup["key_fields"] == int(pdf.duplicated(subset=keys).sum())
    ages = __import__("pandas").to_numeric(pdf["NU_IDADE_N"], errors="coerce")
    rng = {r.side: r.violations for r in Q.q_ranges(raw).collect()}
    assert rng == {"min": int((ages < 0).sum()), "max": int((ages > 120).sum())}


def test_daily_series_matches_pandas(spark):
    import pandas as pd

    from epispark.operators import series as S

    cases = FX.cases(spark, SMOKE)
    pdf = cases.select("DT_NOTIFIC").toPandas()
    start, end = dt.date(2001, 5, 2), dt.date(2001, 6, 1)
    window = pdf[(pdf.DT_NOTIFIC >= start) & (pdf.DT_NOTIFIC <= end)]
    daily = window.groupby("DT_NOTIFIC").size().rename("n").reset_index()
    full = pd.DataFrame({"DT_NOTIFIC": [d.date() for d in pd.date_range(start, end, freq="D")]})
    full = full.merge(daily, on="DT_NOTIFIC", how="left").fillna({"n": 0})
    full["ma"] = full["n"].rolling(7).mean()
    got = S.moving_average(S.daily_calendar_fill(cases, "2001-06-01", 30)).orderBy("date").collect()
    assert [r.cases for r in got] == [int(x) for x in full["n"]]
    for r, e in zip(got, full["ma"]):
        assert (r.moving_average_7d is None and pd.isna(e)) or abs(r.moving_average_7d - e) < 1e-9
    summ = S.series_summary(S.daily_calendar_fill(cases, "2001-06-01", 30)).first()
    assert summ.peak_cases == int(full["n"].max())
    assert summ.peak_date == full.loc[full["n"].idxmax(), "DT_NOTIFIC"]


def test_article_dedupe_and_topk_match_python(spark):
    from epispark import params as P
    from epispark.operators import news as N

    arts = FX.articles(spark, SMOKE)
    rows = sorted(arts.select("article_id", "title", "summary").collect(), key=lambda r: r.article_id)
    seen, kept = set(), []
    for r in rows:  # keep-first on the stripped, lower-cased title, in article order
        key = (r.title or "").strip(" \t\n\x0b\f\r").lower()
        if key and key not in seen:
            seen.add(key)
            kept.append(r.article_id)
    assert sorted(r.article_id for r in N.article_dedupe(arts).collect()) == kept

    def score(r):
        t = f"{(r.title or '').lower()} {(r.summary or '').lower()}"
        return sum(1 for w in P.RELEVANCE_KEYWORDS if w in t)

    ranked = sorted([r for r in rows if score(r) >= 1], key=lambda r: -score(r))  # stable: ties keep input order
    top = [r.article_id for r in N.article_topk(N.article_relevance(arts), 10).collect()]
    assert top == [r.article_id for r in ranked[:10]]


def test_redaction_matches_python_re(spark):
    import re

    from epispark import params as P
    from epispark.functions import text as TX
    from epispark.operators import privacy as G

    arts = FX.articles(spark, SMOKE)
    rows = arts.select("article_id", "summary", TX.redact("summary").alias("red")).collect()
    for r in rows:
        t = re.sub(P.CPF_PATTERN, P.CPF_REPLACEMENT, r.summary)
        t = re.sub(P.PHONE_PATTERN, P.PHONE_REPLACEMENT, t)
        t = re.sub(P.EMAIL_PATTERN, P.EMAIL_REPLACEMENT, t)
        assert r.red == t, r.article_id
    hits = {r.column: r for r in G.pii_scan(arts).collect()}["summary"]
    assert hits.cpf_hits == sum(1 for r in rows if re.search(P.CPF_PATTERN, r.summary))
    assert hits.email_hits == sum(1 for r in rows if re.search(P.EMAIL_PATTERN, r.summary))


def test_vaccination_cascade_matches_sequential_overwrite(spark):
    from epispark import params as P

    cols = ["DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "DOSE_2REF", "DOSE_ADIC"]
    pdf = FX.cases(spark, SMOKE).select("NU_NOTIFIC", *cols, "STATUS_VACINAL_COVID").toPandas()
    s = pdf[cols].notna()
    status = [P.VAX_UNKNOWN] * len(pdf)
    for i in range(len(pdf)):  # later rules overwrite earlier ones
        r = s.iloc[i]
        if not r.any():
            status[i] = P.VAX_NONE
        if r.DOSE_1_COV and not r.DOSE_2_COV:
            status[i] = P.VAX_ONE
        if r.DOSE_2_COV and not (r.DOSE_REF or r.DOSE_2REF or r.DOSE_ADIC):
            status[i] = P.VAX_TWO
        if r.DOSE_REF and not (r.DOSE_2REF or r.DOSE_ADIC):
            status[i] = P.VAX_BOOSTER
        if r.DOSE_2REF or r.DOSE_ADIC:
            status[i] = P.VAX_EXTRA
    assert list(pdf["STATUS_VACINAL_COVID"]) == status


def test_age_summary_matches_pandas(spark):
    import math

    from epispark.operators import profile as A

    cases = FX.cases(spark, SMOKE)
    ages = cases.select("NU_IDADE_N").toPandas()["NU_IDADE_N"].dropna()
    s = A.age_summary(cases).first()
    assert s.n == len(ages) and s.min == int(ages.min()) and s.max == int(ages.max())
    assert s.mean == math.floor(ages.sum() * 10 / len(ages) + 0.5) / 10
    assert s.median == math.floor(ages.median() * 10 + 0.5) / 10
    r = A.age_ranges(cases).first()
    assert (r.age_0_17, r.age_18_59, r.age_60_plus) == (int((ages < 18).sum()), int(((ages >= 18) & (ages < 60)).sum()),
                                                         int((ages >= 60).sum()))
