"""SparkSession construction and cluster-safe defaults."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults a user would set for this workload; the cluster config wins when present.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the join's output partitioning feeds a
    # later aggregate (e.g. orders x customer, then per-customer sums): one more
    # shuffle after the partial aggregate instead of a third of the rows in one task
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows are narrow where keys are hot, and equal keys compress: a hot key shows less in bytes than in rows
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "bizlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Settings results or skew protection depend on; queries set them in the session they are given.
QUERY_CONF = {k: DEFAULT_CONF[k] for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                                           "spark.sql.adaptive.forceOptimizeSkewedJoin",
                                           "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.session.timeZone")}


def use_query_conf(spark: SparkSession) -> None:
    for k, v in QUERY_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def case_sensitive_session(spark: SparkSession) -> SparkSession:
    """A session of the same application and settings in which names that differ in case alone are two columns.  The
    given session is left as it is; frames made in the new one can be written as they are."""
    s = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if s.conf.isModifiable(k):
            s.conf.set(k, v)
    s.conf.set("spark.sql.caseSensitive", "true")
    return s


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local runs, tests) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    local = tempfile.mkdtemp(prefix="bizlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local
