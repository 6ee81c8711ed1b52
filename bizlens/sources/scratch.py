"""Scratch locations for jobs that write intermediate files.

On a cluster they live under the shared ``spark.checkpoint.dir`` (never a
machine-local temp folder); a local default is created only when that setting
is unset, as in tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/bizlens-scratch/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` materialized as parquet in the shared scratch folder and read back.
    Like a reliable checkpoint it cuts lineage and survives executor loss; unlike
    a checkpoint's serialized rows, every later reader gets column pruning,
    predicate pushdown and compressed columnar scans."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
