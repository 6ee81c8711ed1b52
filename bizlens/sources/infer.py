"""CSV with an inferred schema and a reject table.

Every cell of every line is classed (missing, whole number, number, boolean, date, instant, text) and one aggregate
counts the classes of all columns; the join of the classes in a small lattice is the column's type.  No head
sample decides, and every cell fits its column's type.

    missing < boolean < text
    missing < whole < number < text
    missing < date < instant < text

Lines that do not have the header's number of fields, or whose quotes do not close, go to the reject table with file, line number and
reason, as do lines with a cell that does not fit where a type is given by the caller.  Line numbers are exact: lines are numbered
inside their file split, and the splits' line counts are added up.

One record is one line (no line breaks inside quotes).  Empty lines are skipped.  A first line that equals the header is one, in every
file.  Column names may be any; a blank one becomes its place, ``_0``, ``_1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import bounded_broadcast
from .files import MISSING_TOKENS

CLASSES = ("whole", "number", "boolean", "date", "instant", "text")
_WHOLE, _NUMBER = r"\A[+-]?[0-9]{1,19}\z", r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_TYPES = {"whole": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
          "instant": T.TimestampNTZType(), "text": T.StringType()}


def is_missing(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin(MISSING_TOKENS)


def cell_class(c: Column) -> Column:
    """The least class a cell is in; null for a missing one."""
    t = F.trim(c)
    return F.when(is_missing(c), None) \
        .when(t.rlike(_WHOLE) & t.try_cast("bigint").isNotNull(), "whole").when(t.rlike(_NUMBER), "number") \
        .when(F.lower(t).isin("true", "false"), "boolean") \
        .when(t.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & t.try_cast("date").isNotNull(), "date") \
        .when(t.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?\z")
              & t.try_cast("timestamp_ntz").isNotNull(), "instant").otherwise("text")


def join_classes(seen: set[str]) -> str:
    """The least class above all those seen; text where nothing was."""
    for chain in (("boolean",), ("whole", "number"), ("date", "instant")):
        if seen and seen <= set(chain):
            return max(seen, key=chain.index)
    return "text"


def fit(c: Column, to: T.DataType) -> Column:
    """A cell as the type; null where it is missing or does not fit (``misfit`` tells which)."""
    t = F.trim(c)
    value = c if isinstance(to, T.StringType) else t.try_cast(to)
    return F.when(~is_missing(c), value)


def misfit(c: Column, to: T.DataType) -> Column:
    return ~is_missing(c) & fit(c, to).isNull()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, record`` of every line of a text source; lines count from 1 in their file."""
    raw = spark.read.text(path).select(
        F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mid"))
    splits = raw.groupBy("file", "at").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)    # a row a split
    start = splits.select("file", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(bounded_broadcast(start), ["file", "at"]) \
        .select("file", (F.col("mid") + F.col("shift") + 1).alias("line"), "record")


def header_names(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The header line (of the first file) and its names."""
    line = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    if line is None:
        return "", []
    cells = spark.range(1).select(F.from_csv(F.lit(line[0]), F.lit(
        ", ".join(f"_c{i} string" for i in range(line[0].count(",") + 1)))).alias("r")).first()["r"]
    n = max((i + 1 for i, v in enumerate(cells) if v is not None), default=1)
    names = [("" if v is None else str(v)).strip() or f"_{i}" for i, v in enumerate(cells[:n])]
    return line[0], names


def parsed_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``file, line, record, broken, c0, c1, ...`` with all cells as text, and the column names."""
    head, names = header_names(spark, path)
    lines = numbered_lines(spark, path).where((F.length(F.trim("record")) > 0) & ~((F.col("line") == 1) & (F.col("record") == head)))
    schema = ", ".join([*[f"c{i} string" for i in range(len(names))], "_broken string"])
    cells = F.from_csv("record", F.lit(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "escape": '"'})
    got = lines.withColumn("r", cells)
    return got.select("file", "line", "record", F.col("r._broken").isNotNull().alias("broken"),
                      *[F.col(f"r.c{i}") for i in range(len(names))]), names


def infer_schema(spark: SparkSession, path: str) -> T.StructType:
    """The least types that all cells of the well-formed lines fit."""
    rows, names = parsed_lines(spark, path)
    if not names:
        return T.StructType([])
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), cell_class(F.col(f"c{i}")).alias("class")) for i in range(len(names))])
    seen: dict[int, set[str]] = {}
    for r in rows.where(~F.col("broken")).select(F.explode(cells).alias("c")).select("c.*").where(F.col("class").isNotNull()) \
            .distinct().collect():                      # at most six rows a column
        seen.setdefault(r["pos"], set()).add(r["class"])
    return T.StructType([T.StructField(n, _TYPES[join_classes(seen.get(i, set()))]) for i, n in enumerate(names)])


def read_csv_inferred(spark: SparkSession, path: str, given: dict[str, T.DataType] | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects).  ``given`` fixes the types of some columns; the others are inferred.  Rejects have ``file, line, reason,
    record``; a line is rejected for its first reason."""
    inferred = infer_schema(spark, path)
    rows, names = parsed_lines(spark, path)
    given = given or {}
    types = [given.get(f.name, f.dataType) for f in inferred.fields]
    reason = F.when(F.col("broken"), "fields")
    for i, (n, t) in enumerate(zip(names, types)):
        if n in given:
            reason = reason.when(misfit(F.col(f"c{i}"), t), f"type: {n}")
    judged = rows.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(*[fit(F.col(f"c{i}"), t).alias(n) for i, (n, t) in enumerate(zip(names, types))])
    bad = judged.where(F.col("reason").isNotNull()).select("file", "line", "reason", "record")
    return good, bad


__all__ = ["cell_class", "infer_schema", "join_classes", "read_csv_inferred"]
