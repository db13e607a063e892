"""Corpus pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from epispark.llm.common import landed, table
from epispark.llm.decontaminate import decontaminate
from epispark.llm.language_id import identify, least_fits, train
from epispark.llm.line_dedup import line_dedup
from epispark.llm.simhash_dedup import simhash_groups
from epispark.llm.source_mix import mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: rejected are those without a
    letter (or a text), those whose best language has less than half of the
    likelihood, and those whose characters are far less likely in it than
    those of its labelled documents.  With nothing to learn from, only texts
    without a letter are rejected."""
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = identify(docs, model, ["doc_id", "lang", "source", "n_chars", "text"], with_fit=True)
    least = F.lit(None).cast("double")
    for lang, fit in least_fits(docs, model).items():
        least = F.when(F.col("lang_pred") == lang, fit).otherwise(least)
    fits = F.coalesce(F.col("fit") >= least, F.lit(True))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & fits).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that occur earlier, exactly or, from
    30 bytes on, within two edits; ``n_chars`` follows the text."""
    kept = line_dedup(docs, max_edits=2, min_bytes=1, edit_bytes=30, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the least id, null
    ids last; of rows that share it the one with the least hash of its
    columns.  Groups are of rows, not of ids, so unlike rows that share an id
    all stay, and copies without ids are reduced like any others.  Of rows
    repeated whole one stays."""
    marks = [F.col(c).isNull() for c in COLUMNS]  # a hash passes over nulls
    keyed = docs.select(F.xxhash64(*COLUMNS, *marks).alias("_k"), F.xxhash64(F.lit(1), *COLUMNS, *marks).alias("_g"), *COLUMNS)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k", "_g")
    groups = simhash_groups(keyed.select(row.alias("row"), "text"), id_col="row", shingle=3, max_bits=2)
    heads = groups.select("component_id._k", "component_id._g").distinct()
    single = keyed.groupBy("_k", "_g").agg(F.first(F.struct(*COLUMNS)).alias("doc"))  # equal rows: any of them
    return single.join(heads, ["_k", "_g"], "left_semi").select("doc.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    hit = decontaminate(docs.select(F.struct(*COLUMNS).alias("doc"), "text"), table(spark, sf_dir, "benchmark"), id_col="doc", window=10)
    return hit.where("n_hit = 0").select("doc.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: the columns of the operator."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mix", mix_stage),
]

# Language models, fingerprints and edit links have no SQL form; the tests
# compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
