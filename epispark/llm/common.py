"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from epispark.session import scratch_path

SLICE_BYTES = 1 << 18
# Arrow batches between Spark and Python: rows and bytes at most.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut of the
    lineage that survives the loss of executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece stay near ``most``
    bytes; a longer text is a piece of its own, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with small batches, so that a Python worker holds a few
    megabytes of text at a time (a longer text alone); the session keeps
    smaller limits of its own."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to ``BATCH_LIMITS``.  They stay
    lowered: plans are lazy, so the limits must hold when they run."""
    for name, most in BATCH_LIMITS.items():
        now = int(str(spark.conf.get(name)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))
