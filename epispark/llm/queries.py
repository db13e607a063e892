"""Registered queries of the training-data operators: ``opN_<name>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from epispark.llm.common import table
from epispark.llm.decontaminate import decontaminate
from epispark.llm.exact_topk import exact_topk
from epispark.llm.html_extract import extract
from epispark.llm.language_id import language_id
from epispark.llm.line_dedup import line_dedup
from epispark.llm.nearest import nearest
from epispark.llm.oracle import ORACLE
from epispark.llm.periodic_runs import periodic_runs
from epispark.llm.secret_scan import secret_scan
from epispark.llm.simhash_dedup import simhash_groups
from epispark.llm.source_mix import mix_sources
from epispark.llm.substring_dedup import substring_dedup
from epispark.llm.suffix_dedup import suffix_dedup
from epispark.llm.vector_codes import vector_codes


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), max_edits=2, min_bytes=1, edit_bytes=30).withColumn(
        "kept_sha256", F.sha2(F.col("kept"), 256)).drop("kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_markov")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), size=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col``, in which every tenth document (by the
    CRC-32 h of its id) repeats a stretch of itself from word a = h div 10 mod
    n to its end: word i becomes word a + (i - a) mod p, for p = 1 +
    (n - a) div (3 + h div 10 mod 8).  Null ids and texts without words stay."""
    h = F.crc32(F.col(id_col).cast("string"))
    held = F.struct(F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), F.expr("h div 10").alias("g"))
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluated once

    def tail(x):
        n = F.size(x["w"]).cast("long")
        return bound(F.struct(x["w"].alias("w"), n.alias("n"), F.pmod(x["g"], n).alias("a"), F.pmod(x["g"], F.lit(8)).alias("e")), repeat)

    def repeat(x):
        p = F.floor((x["n"] - x["a"]) / (x["e"] + 3)) + 1
        return bound(F.struct(x["w"].alias("w"), x["n"].alias("n"), x["a"].alias("a"), p.alias("p")), lambda y: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), y["n"] - 1),
            lambda i: F.get(y["w"], F.when(i < y["a"], i).otherwise(y["a"] + (i - y["a"]) % y["p"]).cast("int"))), " "))

    planted = bound(held, lambda x: F.when(F.size(x["w"]) > 0, tail(x)))
    return docs.select(F.col(id_col), F.col(text_col), h.alias("h")).select(
        id_col, F.when(F.col("h") % 10 == 0, F.coalesce(planted, F.col(text_col))).otherwise(F.col(text_col)).alias(text_col))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated_tails(table(spark, sf_dir, "documents")), least_repeats=4, shortest=6)
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("*", greatest.alias("g")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("g.s")).alias("start"), F.col("g.l").alias("length"), (-F.col("g.p")).alias("period"),
        F.expr("1000 * g.l div -g.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256).select(
        "vec_id", "code", "error", "label_error", F.sha2(F.col("codebooks"), 256).alias("codebooks_sha256"))


__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_source_mix, op3_line_dedup, op4_language_id, op5_nearest, op6_secret_scan, op7_decontaminate, op8_html_extract, op9_suffix_dedup, op10_simhash_dedup,
                              op11_periodic_runs, op12_exact_topk, op13_vector_codes)
}