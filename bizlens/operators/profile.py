"""Data card of any DataFrame (family A): shape, per-column types and nulls,
exact distinct counts, numeric quantiles, top values, likely id / date columns,
target distribution and duplicate counts.

Plan shape: null shares come from one wide aggregate, min/max/mean from the long form.  Distinct
counts and top values come from one long ``(column, value)`` aggregate, so a
value that holds a third of a column is a single row after partial aggregation
(no ``count(distinct)`` Expand per column).  Quantiles are exact and distributed
(``ranking``).  Top-k per column is a group-limited window (k rows per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import position, positional
from ..functions.numeric import rnd
from .dateformats import readable
from .ranking import quantiles

MAX_LEVELS = 8
ID_SHARE = 0.95
ID_MARGIN = 0.3            # share of the bound within which a sketch does not decide
DATE_SHARE = 0.9
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def _missing(field: T.StructField) -> F.Column:
    c = F.col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def profile_shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))


def profile_columns(df: DataFrame) -> DataFrame:
    """dtype and percent missing (2 dp) of every column, in one aggregate."""
    df, label = positional(df)
    fields = df.schema.fields
    a = df.agg(*[F.avg(_missing(f).cast("double")).alias(f"m{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label[f.name]).alias("column"),
                              F.lit(f.dataType.simpleString()).alias("dtype"),
                              F.col(f"m{i}").alias("m")) for i, f in enumerate(fields)])
    return a.select(F.explode(rows).alias("r")).select(
        "r.pos", "r.column", "r.dtype", rnd(F.col("r.m") * 100, 2).alias("null_pct"))


def long_cell(field: T.StructField) -> F.Column:
    """A cell as text, NULL when missing: the value the long format carries.  Equal values have equal
    text: -0.0 is written 0.0, and instants are written in UTC whatever the session's zone."""
    c = F.col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0).cast(field.dataType)).otherwise(c)
    elif isinstance(field.dataType, T.TimestampType):
        c = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    return F.when(~_missing(field), c.cast("string"))


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value-as-text) for non-missing cells of the given columns."""
    df, label = positional(df)
    fields = [f for f in df.schema.fields if columns is None or label[f.name] in columns]
    cells = F.array(*[F.struct(F.lit(label[f.name]).alias("column"), long_cell(f).alias("value")) for f in fields]) \
        if fields else F.array().cast("array<struct<column:string,value:string>>")
    return df.select(F.explode(cells).alias("c")).select("c.column", "c.value") \
        .where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The one shuffle behind distinct counts, top values and level checks."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_distinct(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Exact distinct counts from the long (column, value) aggregate; ``approx`` uses
    HyperLogLog++ sketches in one wide aggregate instead (no shuffle of values)."""
    if approx:
        df, label = positional(df)
        fields = df.schema.fields
        a = df.agg(*[F.approx_count_distinct(F.when(~_missing(f), F.col(f.name)), rsd).alias(f"d{i}")
                     for i, f in enumerate(fields)])
        rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(label[f.name]).alias("column"),
                                  F.col(f"d{i}").alias("n_unique")) for i, f in enumerate(fields)])
        return a.select(F.explode(rows).alias("r")).select("r.pos", "r.column", "r.n_unique")
    counts = value_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    names = df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(df.schema.fields)],
                                            "pos int, column string")
    return names.join(counts, "column", "left").select(
        "pos", "column", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"))


def profile_numeric(df: DataFrame, digits: int = 3, approx: bool = False,
                    accuracy: int = 10_000) -> DataFrame:
    """min, quartiles (linear interpolation), max and mean of numeric columns that
    have any value; rounded to ``digits``.  ``approx`` swaps the exact quartiles for
    ``percentile_approx`` (one sketch per column, no ranking jobs)."""
    df, label = positional(df)
    num = [f for f in df.schema.fields if is_numeric(f.dataType)]
    cells = F.array(*[F.struct(F.lit(label[f.name]).alias("column"),
                               F.when(~_missing(f), F.col(f.name).cast("double")).alias("x")) for f in num]) \
        if num else F.array().cast("array<struct<column:string,x:double>>")
    long = df.select(F.explode(cells).alias("c")).select("c.column", "c.x").where(F.col("x").isNotNull())
    basic = long.groupBy("column").agg(F.min("x").alias("min"), F.max("x").alias("max"),
                                       F.avg("x").alias("mean"))
    if approx:
        q = long.groupBy("column").agg(
            F.percentile_approx("x", [0.25, 0.5, 0.75], accuracy).alias("_q"))
        q = q.select("column", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("median"),
                     F.col("_q")[2].alias("p75"))
    else:
        q = quantiles(long, "x", {"p25": 0.25, "median": 0.5, "p75": 0.75}, ["column"])
    j = basic.join(q, "column")
    return j.select("column", *[rnd(c, digits).alias(c) for c in ("min", "p25", "median", "p75", "max", "mean")])


def profile_top_values(df: DataFrame, k: int = MAX_LEVELS) -> DataFrame:
    """Top k values by frequency of each non-numeric column, ties by value.  One scan
    and one (column, value) aggregate; the ``row_number() <= k`` filter makes Spark
    plan a partial WindowGroupLimit before the shuffle, so every map task sends at
    most k rows per column (a column with billions of distinct values never lands
    in one task)."""
    cols = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    counts = value_counts(df, cols)
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k) \
        .select("column", "value", F.col("n").alias("count"))


def profile_likely_ids(df: DataFrame) -> DataFrame:
    """Columns whose distinct values exceed 95 % of the rows.  A sketch of every column decides where it is far from that share
    (more than ``ID_MARGIN``, six standard errors); only the values of the others are counted exactly."""
    rough = profile_distinct(df, approx=True, rsd=ID_MARGIN / 6)
    rows = df.count()
    near = [r["column"] for r in rough.collect() if r["n_unique"] >= rows * ID_SHARE * (1 - ID_MARGIN)]
    counts = value_counts(df, near).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    return counts.where(F.col("n_unique") > F.lit(rows * ID_SHARE)).select("column", "n_unique")


def profile_likely_dates(df: DataFrame) -> DataFrame:
    """Typed date/timestamp columns count at once; text columns when more than 90 %
    of their non-null values parse as a timestamp or in one of the forms of ``dateformats`` (all values, not a head sample)."""
    df, label = positional(df)
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType,) + DATE_TYPES)]
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f.name)
        if isinstance(f.dataType, DATE_TYPES):
            aggs.append(F.when(F.count(c) > 0, F.lit(1.0)).alias(f"s{i}"))
        else:
            parsed = F.coalesce(F.try_to_timestamp(c).isNotNull(), F.lit(False)) | readable(c)
            aggs.append(F.try_divide(F.count(F.when(parsed, F.lit(1))).cast("double"),
                                     F.count(c).cast("double")).alias(f"s{i}"))
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, parse_share double, likely_date boolean")
    a = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(label[f.name]).alias("column"), F.col(f"s{i}").alias("s"))
                     for i, f in enumerate(fields)])
    e = a.select(F.explode(rows).alias("r")).select("r.column", "r.s")
    return e.select("column", rnd(F.coalesce("s", F.lit(0.0)), 4).alias("parse_share"),
                    (F.coalesce("s", F.lit(0.0)) > DATE_SHARE).alias("likely_date"))


def profile_target(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """Shares of the 10 most frequent target values, NULL included; is-binary flag."""
    key = position(df, target)
    df, _ = positional(df)
    counts = df.groupBy(F.col(key).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    # total and distinct non-null levels both come from the one per-value aggregate
    total = counts.agg(F.sum("n")).scalar()
    levels = counts.where(F.col("level").isNotNull()).agg(F.count(F.lit(1))).scalar()
    topk = counts.orderBy(F.desc("n"), F.asc_nulls_first("level")).limit(top)
    return topk.select(F.col("level").cast("string").alias("value"),
                       rnd(F.col("n") / total, 4).alias("share"),
                       (levels == 2).alias("is_binary"))


def row_digest(df: DataFrame) -> list[F.Column]:
    """Two 64-bit hashes of a whole row with different seeds.  Equal rows (nulls equal, as in a group-by) have equal digests."""
    cells = [F.col(c) for c in df.columns]
    return [F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit(2), *cells, F.lit(3)).alias("_h2")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(n)``: the size of every group of equal rows with two members and more.

    Rows are first counted by their digest: 16 bytes a row move, whatever its width.  Only rows whose digest
    occurs twice are then grouped by their whole values, so that a collision of digests cannot count as a duplicate."""
    df, _ = positional(df)
    digests = df.select(*row_digest(df)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    again = df.select("*", *row_digest(df)).join(digests.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
    return again.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("n")


def duplicate_counts(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Surplus copies (keep-first duplicates, A6) and duplicate members (every copy,
    C1) over the given columns; NULLs compare equal, as in a group-by."""
    if columns is not None:
        keys = [position(df, c) for c in columns]
        df = positional(df)[0].select(*keys)
    rows = df.agg(F.count(F.lit(1))).scalar()
    g = duplicate_rows(df).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
                               F.coalesce(F.sum("n"), F.lit(0)).alias("members"))
    return g.select(F.lit(name).alias("dataset"), rows.alias("rows"), "surplus", "members")
