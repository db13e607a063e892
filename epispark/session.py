"""Session helpers: a local session for tests and benches, and the shared
scratch location taken from ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "epispark") -> SparkSession:
    """Local session with the settings the library assumes (UTC, AQE, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # A fused stage whose generated method exceeds HotSpot's 8000-byte
        # JIT limit runs interpreted (3x slower here); above this size Spark
        # compiles the stage operator by operator instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset on a local master (tests, local runs) a
    fresh local folder is created and registered; elsewhere that folder would
    be another one on every machine, so an unset value is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        _set_rdd_checkpoint_dir(spark, current)
        return current
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="epispark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    _set_rdd_checkpoint_dir(spark, path)
    return path


def _set_rdd_checkpoint_dir(spark: SparkSession, path: str) -> None:
    """Also point ``DataFrame.checkpoint()`` at the folder (classic sessions
    only; a Connect session has no SparkContext)."""
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001
        pass


def scratch_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path under the shared checkpoint directory for written tables."""
    root = ensure_checkpoint_dir(spark)
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    return os.path.join(root, "tables", leaf)
