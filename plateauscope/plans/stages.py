"""Materialised stages of the audit.

A stage is written as Parquet in the shared folder the cluster names in
``spark.checkpoint.dir`` and read back. That cuts lineage, survives the loss of
executors, and gives the optimiser the real size of what follows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MEMO: dict[tuple, DataFrame] = {}


def stage_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/") + "/plateauscope"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:  # single-machine runs and tests only
        _LOCAL[app] = tempfile.mkdtemp(prefix="plateauscope-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{stage_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def memo(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Build and stage a shared relation once per application."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _MEMO:
        _MEMO[full] = stage(build(), str(key[-1]))
    return _MEMO[full]


def forget() -> None:
    """Drop the references to staged relations (the next use builds them anew)."""
    _MEMO.clear()
