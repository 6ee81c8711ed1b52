"""The whole data card of a table (A1 to A9) from one scan and one shuffle of its values.

Every row gives its cells as (column, value) and, under a column of its own, its digest.  One aggregate counts them;
it is written once, and every section reads the counts: shape, types and missing shares, distinct counts, likely
ids, quartiles (ranked over distinct values), top values, likely dates, target mix, duplicate rows.  Only if
a digest occurs twice is the table read again, for the rows with such digests alone: they are compared whole.

Defined results: an empty table has zero rows, null shares and no values; a column without values has no numeric or
top rows; column names may be any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import position, positional
from ..functions.numeric import rnd
from ..sources.scratch import written_table
from .dateformats import readable
from .profile import DATE_SHARE, DATE_TYPES, ID_SHARE, MAX_LEVELS, is_numeric, long_cell, row_digest
from .ranking import quantiles

ROW = -1            # the pseudo-column of row digests
COLUMNS = ("section", "column", "key", "n", "x")


def _value_counts(x: DataFrame) -> DataFrame:
    digest = F.concat_ws(":", *[F.hex(h) for h in row_digest(x)])
    cells = [F.struct(F.lit(ROW).alias("pos"), digest.alias("value"))] + [
        F.struct(F.lit(i).alias("pos"), long_cell(f).alias("value")) for i, f in enumerate(x.schema.fields)]
    return x.select(F.explode(F.array(*cells)).alias("c")).select("c.pos", "c.value").where(F.col("value").isNotNull()) \
        .groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(x: DataFrame, counts: DataFrame) -> DataFrame | None:
    """Sizes ``n`` of the groups of equal rows; None if no two rows share a digest."""
    twice = counts.where((F.col("pos") == ROW) & (F.col("n") > 1)).select("value")
    if twice.isEmpty():
        return None
    digest = F.concat_ws(":", *[F.hex(h) for h in row_digest(x)])
    return x.withColumn("value", digest).join(twice, "value", "left_semi") \
        .groupBy(*x.columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("n")


def data_card(df: DataFrame, name: str, target: str | None = None, digits: int = 3, top: int = MAX_LEVELS) -> DataFrame:
    """Rows ``dataset, section, column, key, n, x``; see the module for the sections."""
    spark = df.sparkSession
    y = position(df, target) if target is not None else None
    x, label = positional(df)
    fields = x.schema.fields
    counts = written_table(_value_counts(x), "card-values")
    columns = spark.createDataFrame(
        [(i, label[f.name], f.dataType.simpleString(), is_numeric(f.dataType), isinstance(f.dataType, DATE_TYPES),
          isinstance(f.dataType, T.StringType)) for i, f in enumerate(fields)],
        "pos int, column string, dtype string, numeric boolean, dated boolean, texts boolean")     # one row a column
    text = F.col("pos").isin([i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)])
    # read by many sections: every value is tried as a date once, and the result, a row a column, is written
    sums = written_table(counts.groupBy("pos").agg(
        F.count(F.lit(1)).alias("levels"), F.sum("n").alias("filled"),
        F.sum(F.when(text & (F.try_to_timestamp("value").isNotNull() | readable(F.col("value"))), F.col("n")).otherwise(0))
        .alias("dates")), "card-columns")
    total = F.coalesce(sums.where(F.col("pos") == ROW).agg(F.sum("filled")).scalar(), F.lit(0).cast("bigint"))
    per = columns.join(F.broadcast(sums), "pos", "left").na.fill(0, ["levels", "filled", "dates"])

    parts: list[DataFrame] = []

    def add(src: DataFrame, section: str, column: Column, key: Column, n: Column, x: Column) -> None:
        parts.append(src.select(F.lit(section).alias("section"), column.cast("string").alias("column"),
                                key.cast("string").alias("key"), n.cast("bigint").alias("n"), x.cast("double").alias("x")))

    none, one = F.lit(None), spark.range(1)
    add(one, "shape", none, F.lit("rows"), total, none)
    add(one, "shape", none, F.lit("columns"), F.lit(len(fields)), none)
    add(per, "columns", F.col("column"), F.col("dtype"), F.col("pos"),
        rnd(F.try_divide((total - F.col("filled")).cast("double"), total.cast("double")) * 100, 2))
    add(per, "distinct", F.col("column"), none, F.col("levels"), none)
    add(per.where(F.col("levels") > total * F.lit(ID_SHARE)), "likely id", F.col("column"), none, F.col("levels"), none)
    share = F.when(F.col("dated") & (F.col("filled") > 0), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(F.col("dates").cast("double"), F.col("filled").cast("double")), F.lit(0.0)))
    add(per.where(F.col("dated") | F.col("texts")).withColumn("share", share), "likely date", F.col("column"),
        F.col("share") > DATE_SHARE, none, rnd(F.col("share"), 4))

    named = columns.select("pos", "column", "numeric")
    numbers = counts.join(F.broadcast(named.where("numeric")), "pos").select("column", F.col("value").try_cast("double").alias("v"), "n")
    basic = numbers.groupBy("column").agg(F.min("v").alias("min"), F.max("v").alias("max"),
                                          (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    spread = basic.join(quantiles(numbers, "v", {"p25": 0.25, "median": 0.5, "p75": 0.75}, ["column"], counted="n").drop("n"), "column")
    measures = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v"))
                                   for k in ("min", "p25", "median", "p75", "max", "mean")]))
    add(spread.select("column", measures.alias("m")), "numeric", F.col("column"), F.col("m.k"), none, rnd(F.col("m.v"), digits))

    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    best = counts.join(F.broadcast(named.where(~F.col("numeric"))), "pos").withColumn("_r", F.row_number().over(order)) \
        .where(F.col("_r") <= top)
    add(best, "top values", F.col("column"), F.col("value"), F.col("n"), none)

    if y is not None:
        level = int(y[2:])
        mix = counts.where(F.col("pos") == level).select("value", "n").unionByName(
            per.where((F.col("pos") == level) & (F.col("filled") < total)).select(
                F.lit(None).cast("string").alias("value"), (total - F.col("filled")).alias("n")))
        add(mix.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(10), "target", F.lit(target), F.col("value"), none,
            rnd(F.col("n") / total, 4))

    groups = duplicate_groups(x, counts)
    twice = one.select(F.lit(0).alias("surplus"), F.lit(0).alias("members")) if groups is None else \
        groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))
    for k in ("surplus", "members"):
        add(twice, "duplicates", none, F.lit(k), F.col(k), none)
    return reduce(DataFrame.unionByName, parts).select(F.lit(name).alias("dataset"), *COLUMNS)
