"""Report export (S6-S8): every requested report written under one output folder,
replacing the previous copy (the "latest" semantics of the reference).  Each
report is written by Spark from the executors; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

FORMATS = ("json", "csv", "parquet")


def export_reports(spark: SparkSession, sf_dir: str, out_dir: str, names: Iterable[str],
                   fmt: str = "json") -> dict[str, str]:
    """Write each named query's result to ``out_dir/<name>`` (overwrite)."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    from ..plans.queries import REGISTRY
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise KeyError(f"unknown reports: {unknown}")
    out = {}
    for name in names:
        path = f"{out_dir.rstrip('/')}/{name}"
        w = REGISTRY[name](spark, sf_dir).write.mode("overwrite")
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(path)
        out[name] = path
    return out
