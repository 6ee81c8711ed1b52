"""Publishing tables so that no reader meets half a copy.

A copy is written to a folder of its own; only when all its tables are there does a commit name it.  Commits are
small numbered files under ``_commits``, written aside and renamed into place, and a number that is taken is
refused; readers follow the greatest.  A writer that is killed leaves a folder that no commit names, and the
latest copy stays readable.  Copies named by older commits than the last ``keep`` are deleted, so a reader has as many
publications' time to finish.

Defined results: reading where nothing was published raises ``NothingPublished``; an empty table is a copy like any
other; two writers at once publish one after the other, unless one says which number it ``expected`` to follow: then the
later raises ``Conflict``.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

COMMITS = "_commits"


class NothingPublished(FileNotFoundError):
    pass


class Conflict(RuntimeError):
    pass


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits that are there, ascending."""
    fs, folder = _hadoop(spark, f"{path.rstrip('/')}/{COMMITS}")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def _body(spark: SparkSession, path: str, number: int) -> dict:
    fs, file = _hadoop(spark, f"{path.rstrip('/')}/{COMMITS}/{number:012d}")
    stream = fs.open(file)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and contents of the last commit; (0, {}) before the first."""
    numbers = commits(spark, path)
    return (numbers[-1], _body(spark, path, numbers[-1])) if numbers else (0, {})


def commit(spark: SparkSession, path: str, folders: list[str], body: dict, expected: int | None = None, keep: int = 2) -> int:
    """Name ``folders`` (under ``path``) as the latest copy; returns the commit's number."""
    path = path.rstrip("/")
    jvm = spark.sparkContext._jvm
    fs, aside = _hadoop(spark, f"{path}/{COMMITS}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(body | {"folders": folders}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(aside).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    while True:
        last = (commits(spark, path) or [0])[-1]
        if expected is not None and last != expected:
            fs.delete(aside, False)
            raise Conflict(f"{path}: commit {last} is there, {expected} was expected")
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}/{last + 1:012d}")
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(place), no_options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            continue                                   # another writer was faster: look again
        prune(spark, path, keep)
        return last + 1


def prune(spark: SparkSession, path: str, keep: int) -> None:
    """Delete the folders that only commits before the last ``keep`` name, then those commits."""
    numbers = commits(spark, path)
    old, kept = numbers[:-keep], numbers[-keep:]
    needed = {f for n in kept for f in _body(spark, path, n)["folders"]} if old else set()
    for n in old:
        for folder in set(_body(spark, path, n)["folders"]) - needed:
            fs, p = _hadoop(spark, f"{path}/{folder}")
            fs.delete(p, True)
        fs, p = _hadoop(spark, f"{path}/{COMMITS}/{n:012d}")
        fs.delete(p, False)


def publish_all(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", expected: int | None = None, keep: int = 2) -> int:
    """Write all ``tables`` and make them the latest copy together; returns the commit's number."""
    if not tables:
        raise ValueError("nothing to publish")
    path, folder = path.rstrip("/"), f"copy-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.option("header", True).format(fmt).save(f"{path}/{folder}/{name}")
    body = {"format": fmt, "tables": {name: f"{folder}/{name}" for name in tables},
            "schemas": {name: df.schema.json() for name, df in tables.items()}}
    return commit(df.sparkSession, path, [folder], body, expected, keep)


def publish(df: DataFrame, path: str, fmt: str = "parquet", expected: int | None = None, keep: int = 2) -> int:
    return publish_all({"table": df}, path, fmt, expected, keep)


def read_latest(spark: SparkSession, path: str, name: str = "table") -> DataFrame:
    """A table of the latest copy, with the columns and types it was published with."""
    number, body = latest(spark, path)
    if not number or name not in body["tables"]:
        raise NothingPublished(f"{name} under {path}")
    schema = StructType.fromJson(json.loads(body["schemas"][name]))
    return spark.read.option("header", True).schema(schema).format(body["format"]).load(f"{path.rstrip('/')}/{body['tables'][name]}")
