"""Sinks (S8, S9): processed cases as partitioned Parquet, quality report as
JSON, in rows or as one nested document."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..operators.quality import RULES

def save_processed(df: DataFrame, path: str, partition_by=("ANO", "MES"), max_records_per_file: int = 5_000_000,
                   derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Overwrite ``path`` with ``df`` partitioned by year and month.

    ``rebalance`` on the partition columns groups each month's rows before
    the write, so the table gets about one file per month instead of one
    per (task, month) - the small-files problem of partitioned writes.
    AQE splits a month larger than the advisory partition size into
    several tasks, so a hot month never lands in a single task.  Rows are
    then date-sorted inside each file for tight row-group statistics.

    Columns that follow from the others can be left to ``derive``, which adds
    them after the rows were shuffled and sorted, so that neither moves them.
    """
    order = list(partition_by) + (["DT_NOTIFIC"] if "DT_NOTIFIC" in df.columns else [])
    placed = df.hint("rebalance", *partition_by).sortWithinPartitions(*order)
    ((derive(placed) if derive else placed).write.mode("overwrite")
     .option("maxRecordsPerFile", max_records_per_file).partitionBy(*partition_by).parquet(path))


def replace_months(df: DataFrame, path: str, partition_by=("ANO", "MES")) -> None:
    """S8 for part of the table: the months that ``df`` holds replace those at
    ``path``; the files of all others stay as they are.

    The write is staged and moved in at commit, so a lost executor or a second
    run of the same load leaves the same rows, never half a month or a month
    twice.  ``df`` must not be read from the partitions it replaces unless it
    was written elsewhere first."""
    order = list(partition_by) + (["DT_NOTIFIC"] if "DT_NOTIFIC" in df.columns else [])
    (df.hint("rebalance", *partition_by).sortWithinPartitions(*order).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_quality_json(report: DataFrame, path: str) -> None:
    """The long quality table as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def load_quality_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("check string, field string, severity string, message string, value double").json(path)


REPORT_DOCUMENT = (
    "metadata struct<generated_at: string, records: bigint>, "
    "summary struct<passed: boolean, quality_score: double, errors: bigint, warnings: bigint>, "
    "rules array<struct<rule: string, field: string, value: string>>, "
    "details array<struct<check: string, field: string, severity: string, message: string>>")


def quality_rules() -> list[tuple[str, str, str]]:
    """The rules that the quality checks apply: ``(rule, field, value)``."""
    rules = [("required_fields", f, "") for f in P.REQUIRED_FIELDS] + [("date_fields", f, "") for f in P.QUALITY_DATE_FIELDS]
    rules += [("numeric_ranges", f, f"{low}..{high}") for f, (low, high) in P.NUMERIC_RANGES.items()]
    rules += [("categorical_values", f, "|".join(valid)) for f, valid in P.CATEGORICAL_RULES.items()]
    rules += [("temporal_consistency", first, second) for first, second in P.TEMPORAL_PAIRS]
    rules += [("business_rules", name, text) for name, text, _ in RULES]
    rules += [("outlier_detection", P.AGE_COL, f"iqr {P.IQR_FACTOR}")]
    rules += [("duplicate_keys", f, "") for f in P.DUPLICATE_KEYS]
    return rules + [("thresholds", "null_warning_percent", f"{P.NULL_WARNING_PERCENT}"), ("thresholds", "outlier_warning_percent", f"{P.OUTLIER_WARNING_PERCENT}"),
                    ("thresholds", "score_per_error", f"{P.SCORE_PER_ERROR}"),
                    ("thresholds", "score_per_warning", f"{P.SCORE_PER_WARNING}"), ("thresholds", "score_duplicate_weight", f"{P.SCORE_DUPLICATE_WEIGHT}")]


def quality_document(report: DataFrame, generated_at: str) -> DataFrame:
    """S9 nested: the long report (``quality.quality_report``) as one document
    with metadata, summary, rules and details.

    It holds one entry per finding, of which there are as many as checks and
    columns, not rows.  An empty report (no summary) gives nulls and 0."""
    value = lambda name: F.max(F.when((F.col("check") == "summary") & (F.col("field") == name), F.col("value")))
    detail = F.struct("check", "field", "severity", "message")
    rules = F.from_json(F.lit(json.dumps([{"rule": r, "field": f, "value": v} for r, f, v in quality_rules()], ensure_ascii=False)),
                        "array<struct<rule: string, field: string, value: string>>")
    return report.agg(value("total_records").alias("n"), value("passed").alias("p"), value("quality_score").alias("s"), value("errors").alias("e"), value("warnings").alias("w"),
                      F.array_sort(F.collect_list(F.when(F.col("check") != "summary", detail))).alias("details")).select(
        F.struct(F.lit(generated_at).alias("generated_at"), F.coalesce("n", F.lit(0)).cast("bigint").alias("records")).alias("metadata"),
        F.struct((F.col("p") == 1).alias("passed"), F.col("s").alias("quality_score"), F.coalesce("e", F.lit(0)).cast("bigint").alias("errors"),
                 F.coalesce("w", F.lit(0)).cast("bigint").alias("warnings")).alias("summary"),
        rules.alias("rules"), "details")


def save_quality_document(document: DataFrame, path: str) -> None:
    """One JSON document; nulls are written, so that a reader sees every key."""
    document.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_quality_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_DOCUMENT).json(path)


def document_rows(document: DataFrame) -> DataFrame:
    """Every leaf of the document: ``section, name, key, value, text``."""
    row = lambda section, name, key=None, value=None, text=None: F.struct(
        F.lit(section).alias("section"), name.alias("name"), (F.lit(None).cast("string") if key is None else key).alias("key"),
        (F.lit(None).cast("double") if value is None else value.cast("double")).alias("value"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    flat = [row("metadata", F.lit("generated_at"), text=F.col("metadata.generated_at")), row("metadata", F.lit("records"), value=F.col("metadata.records"))]
    flat += [row("summary", F.lit(c), value=F.col(f"summary.{c}")) for c in ("passed", "quality_score", "errors", "warnings")]
    rules = F.transform("rules", lambda r: row("rules", r["rule"], r["field"], None, r["value"]))
    details = F.transform("details", lambda d: row("details", d["check"], F.concat_ws("/", d["severity"], d["field"]), None, d["message"]))
    return document.select(F.inline(F.concat(F.array(*flat), rules, details)))


def append_quality_run(report: DataFrame, path: str, run_id: str, run_at: str) -> None:
    """Q11 run counters: append one row per validation run (id, time,
    passed, errors, warnings, score, records) to a history table."""
    s = (report.where(F.col("check") == "summary")
         .groupBy().pivot("field", ["passed", "errors", "warnings", "quality_score", "total_records"]).agg(F.first("value")))
    (s.select(F.lit(run_id).alias("run_id"), F.to_timestamp(F.lit(run_at)).alias("run_at"),
              (F.col("passed") == 1.0).alias("passed"), F.col("errors").cast("bigint").alias("errors"),
              F.col("warnings").cast("bigint").alias("warnings"), F.col("quality_score"),
              F.col("total_records").cast("bigint").alias("total_records"))
     .write.mode("append").parquet(path))


def quality_run_counters(spark: SparkSession, path: str) -> DataFrame:
    """Totals over the run history: validations, passed, failed, warnings."""
    h = spark.read.parquet(path)
    return h.agg(F.count(F.lit(1)).alias("total_validations"), F.count_if(F.col("passed")).alias("passed_validations"),
                 F.count_if(~F.col("passed")).alias("failed_validations"),
                 F.coalesce(F.sum("warnings"), F.lit(0)).cast("bigint").alias("warnings_generated"))
