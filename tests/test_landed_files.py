"""Landed JSON files, the nested quality document, replaced months."""

import glob
import json
import os

from pyspark.sql import functions as F

from epispark.sources import articles as SA
from epispark.sources import sinks as SK


def _lines(folder, *lines):
    folder.mkdir(exist_ok=True)
    (folder / "a.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n", encoding="utf-8")
    return str(folder)


def test_feed_files_and_their_bad_lines(spark, tmp_path):
    path = _lines(tmp_path / "feed",
                  {"article_id": 1, "title": "Vacinação", "link": "u", "summary": "linha 1\nlinha 2", "published": "Fri, 01 Jun 2001 10:00:00 GMT", "source": "f", "extra": [1]},
                  {"article_id": 2, "title": None, "published": "2001-06-02T23:30:00-03:00"},
                  {"title": "no id", "published": "yesterday"}, "", "   ",
                  '{"title": "broken', "[1, 2]", '"text"', {"article_id": "x"})
    good, bad = SA.read_feed(spark, path)
    rows = sorted((tuple(r) for r in good.collect()), key=str)
    assert [(r[0], r[1], r[2], r[3], str(r[4]), r[5], r[6]) for r in rows] == [
        (1, "Vacinação", "linha 1\nlinha 2", "u", "2001-06-01", "f", "rss"),
        (2, None, "", "", "2001-06-03", None, "rss"), (None, "no id", "", "", "None", None, "rss")]
    assert len({r.file for r in bad.collect()}) == 1 and bad.count() == 4
    assert good.select("title").count() == 3 and good.count() == 3


def test_api_files_hold_responses_or_records(spark, tmp_path):
    record = {"article_id": 5, "title": "T", "url": "u", "description": None, "publishedAt": "2001-06-01T10:00:00Z", "source": {"name": "S"}}
    path = _lines(tmp_path / "api", {"status": "ok", "articles": [record, {**record, "title": ""}, {"title": "bare"}]}, record,
                  {"status": "error", "code": "rateLimited"}, {"status": "ok", "articles": []}, '{"status": "ok", "articles": [')
    good, bad = SA.read_api(spark, path)
    assert sorted((r.title, r.summary, r.link, str(r.published), r.source, r.source_type) for r in good.collect()) == [
        ("T", "", "u", "2001-06-01", "S", "news_api"), ("T", "", "u", "2001-06-01", "S", "news_api"), ("bare", "", "", "None", "News API", "news_api")]
    counts = {r.source_type: r.bad_lines for r in SA.bad_lines(("news_api", bad), ("none", bad.limit(0))).collect()}
    assert counts == {"news_api": 1, "none": 0}


def test_quality_document_round_trip(spark, tmp_path):
    report = spark.createDataFrame(
        [("types", "UTI", "warning", 'não "numérico"; x|y', None), ("required", "DT_NOTIFIC", "error", None, None)]
        + [("summary", f, None, None, v) for f, v in (("total_records", 7.0), ("errors", 1.0), ("warnings", 1.0), ("quality_score", 88.5), ("passed", 0.0))],
        "check string, field string, severity string, message string, value double")
    path = str(tmp_path / "doc")
    made = SK.quality_document(report, "2024-01-01T00:00:00Z")
    SK.save_quality_document(made, path)
    read = SK.load_quality_document(spark, path)
    assert read.collect() == made.collect() and read.count() == 1
    written = json.loads(open(glob.glob(path + "/*.json")[0], encoding="utf-8").readline())
    assert written["summary"] == {"passed": False, "quality_score": 88.5, "errors": 1, "warnings": 1}
    assert [(r["rule"], r["field"], r["value"]) for r in written["rules"]] == SK.quality_rules()
    assert {"check": "required", "field": "DT_NOTIFIC", "severity": "error", "message": None} in written["details"]
    rows = SK.document_rows(read).collect()
    assert len(rows) == 2 + 4 + len(SK.quality_rules()) + 2
    empty = SK.quality_document(report.limit(0), "t").first()
    assert empty.summary.passed is None and empty.metadata.records == 0 and empty.details == []


def test_replacing_a_month_leaves_the_others_files(spark, tmp_path):
    def cases(rows):
        return spark.createDataFrame(rows, "ANO int, MES int, DT_NOTIFIC string, n int")

    path = str(tmp_path / "cases")
    SK.save_processed(cases([(2000, 1, "2000-01-05", 1), (2000, 2, "2000-02-05", 2), (2000, 2, "2000-02-06", 3), (None, None, None, 4)]), path)
    files = lambda month: sorted((f, os.path.getmtime(f)) for f in glob.glob(f"{path}/ANO=2000/MES={month}/*.parquet"))
    before = files(1)
    for _ in range(2):  # repeating the load changes nothing
        SK.replace_months(cases([(2000, 2, "2000-02-07", 5), (2001, 1, "2001-01-01", 6)]), path)
        assert sorted(r.n for r in SK.load_processed(spark, path).collect()) == [1, 4, 5, 6]
    assert files(1) == before
    SK.replace_months(cases([]), path)
    assert SK.load_processed(spark, path).agg(F.count("*")).first()[0] == 4
