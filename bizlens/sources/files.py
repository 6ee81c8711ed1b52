"""CSV / JSON sources and sinks, column contracts, optional inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Schema-level contract check, raised before any job runs."""
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing:
        raise MissingColumnsError(f"{what} is missing columns: {missing}")
    return df


# Cells that stand for a missing value, in any column.
MISSING_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None"]


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Header CSV.  An explicit schema is the production path: cells are read as text, missing-value
    tokens become null, the rest is cast (a cell that is no number in a number column fails the job).  Without
    one the schema is inferred (the profiler's generic entry)."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is None:
        return reader.option("inferSchema", True).option("nullValue", "NA").option("nanValue", "NaN").csv(path)
    text = reader.schema(StructType([StructField(f.name, StringType()) for f in schema.fields])).csv(path)
    return text.select(*[F.when(F.trim(F.col(f"`{f.name}`")).isin(MISSING_TOKENS), None)
                         .otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | None = None,
              multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop FileSystem of the path (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def read_optional(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Absent optional input -> empty DataFrame with the declared schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def write_latest(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The "latest" copy replaced on each run."""
    df.write.mode("overwrite").format(fmt).save(path)
