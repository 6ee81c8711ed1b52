"""Which date format a text column is written in, voted by its values.

A value has a shape (ISO, year first, digits only, three numbers, a month's name) and, by the calendar, the readings
it allows.  Three numbers with the year last may be day first or month first; values that allow one reading only
(a day over 12) decide it for the column.  One aggregate counts (shape, readings) of every column: at most a few
dozen rows a column leave a task, no value does.

Two-digit years are 1969 to 2068.  Month names are English, in full or three letters.  A time after the date is
allowed and not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import positional
from ..functions.numeric import rnd

_TIME = r"(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
# Month names.
MONTHS = ("january february march april may june july august september october november december").split()
_NAME = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + ")"

_N, _Y = "[0-9]{1,2}", "(?:[0-9]{4}|[0-9]{2})"
#: Shapes and their patterns; in those of three numbers day and month can be either way round.
SHAPES = {"year-month-day": rf"[0-9]{{4}}-{_N}-{_N}", "year/month/day": rf"[0-9]{{4}}/{_N}/{_N}", "yearmonthday": "[0-9]{8}",
          "n/n/year": rf"{_N}/{_N}/{_Y}", "n.n.year": rf"{_N}\.{_N}\.{_Y}", "n-n-year": rf"{_N}-{_N}-{_Y}",
          "day name year": rf"{_N}\.?[ -]{_NAME}\.?,?[ -]{_Y}", "name day year": rf"{_NAME}\.? {_N},? [0-9]{{4}}"}
EITHER_WAY = ("n/n/year", "n.n.year", "n-n-year")
#: What a column of three numbers is read as where no value decides.
DEFAULT_ORDER = "month first"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_day(y: Column, m: Column, d: Column) -> Column:
    """Whether year, month and day (integers) are a day of the calendar."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = F.when(m.isin(4, 6, 9, 11), 30).when(m != 2, 31).when(leap, 29).otherwise(28)
    return F.coalesce((y > 0) & m.between(1, 12) & (d >= 1) & (d <= days), F.lit(False))


def _parts(shape: Column, c: Column) -> Column:
    """struct(y, m, d) of a value of that shape, the first of two numbers as month."""
    joined = F.array(*[F.substr(c, F.lit(i), F.lit(n)) for i, n in ((1, 4), (5, 2), (7, 2))])
    tokens = F.when(shape == "yearmonthday", joined).otherwise(F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[a-z]+)"), F.lit(0)))

    def of(t: Column) -> Column:
        at = [F.get(t, F.lit(i)) for i in range(3)]
        year_first, named = shape.startswith("year"), shape == "day name year"
        month = F.when(year_first | named, at[1]).otherwise(at[0])
        day = F.when(year_first, at[2]).when(named, at[0]).otherwise(at[1])
        number = F.coalesce(month.try_cast("int"), F.array_position(F.lit([m[:3] for m in MONTHS]), F.substring(month, 1, 3)).cast("int"))
        return _let(F.when(year_first, at[0]).otherwise(at[2]), lambda y: F.struct(
            (y.try_cast("int") + F.when(F.length(y) > 2, 0).when(y < "69", 2000).otherwise(1900)).alias("y"),
            number.alias("m"), day.try_cast("int").alias("d")))

    return _let(tokens, of)


def readings(c: Column) -> Column:
    """struct(shape, day_first, month_first) of a text that is a date in some reading, else null.  Shapes of
    one order count as readable both ways."""
    c = F.trim(c)
    shape = None
    for name, pattern in SHAPES.items():
        hit = c.rlike(rf"(?i)\A{pattern}{_TIME}\z")
        shape = F.when(hit, name) if shape is None else shape.when(hit, name)

    def read(s: Column) -> Column:
        return _let(_parts(s, c), lambda p: _let(_is_day(p["y"], p["m"], p["d"]), lambda month_first: _let(
            F.when(s.isin(*EITHER_WAY), _is_day(p["y"], p["d"], p["m"])).otherwise(month_first), lambda day_first: F.when(
                day_first | month_first, F.struct(s.alias("shape"), day_first.alias("day_first"), month_first.alias("month_first"))))))

    return _let(shape, lambda s: F.when(s.isNotNull(), read(s)))


def readable(c: Column) -> Column:
    """True where a text is a date in one of the shapes."""
    return F.coalesce(readings(c).isNotNull(), F.lit(False))


def profile_date_format(df: DataFrame) -> DataFrame:
    """One row for each text column and shape that occurs in it: ``column, format, order, n, decisive, share, chosen``.

    ``order`` is how the column's values of that shape are read (day first, month first; empty where the shape says it),
    ``decisive`` how many values allow that reading only, ``n`` the values the order reads, ``share`` their share
    of the column's non-null values, ``chosen`` the format most values have (ties: by name)."""
    df, label = positional(df)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = F.array(*[F.struct(F.lit(label[c]).alias("column"), F.when(F.col(c).isNotNull(), F.struct(readings(F.col(c)).alias("r")))
                               .alias("v")) for c in text]) if text else F.array().cast(
        "array<struct<column:string,v:struct<r:struct<shape:string,day_first:boolean,month_first:boolean>>>>")
    seen = df.select(F.explode(cells).alias("c")).where(F.col("c.v").isNotNull()) \
        .groupBy(F.col("c.column").alias("column"), F.col("c.v.r.shape").alias("shape"),
                 F.col("c.v.r.day_first").alias("day_first"), F.col("c.v.r.month_first").alias("month_first")) \
        .agg(F.count(F.lit(1)).alias("n"))
    day, month = F.col("day_first"), F.col("month_first")
    votes = seen.groupBy("column", "shape").agg(
        F.sum("n").alias("n"), F.sum(F.when(day & ~month, F.col("n")).otherwise(0)).alias("only_day"),
        F.sum(F.when(month & ~day, F.col("n")).otherwise(0)).alias("only_month"))
    total = Window.partitionBy("column")       # a row a shape
    either = F.col("shape").isin(*EITHER_WAY)
    order = F.when(~either, "").when(F.col("only_day") > F.col("only_month"), "day first") \
        .when(F.col("only_month") > F.col("only_day"), "month first").otherwise(DEFAULT_ORDER)
    lost = F.when(F.col("order") == "day first", F.col("only_month")).when(F.col("order") == "month first", F.col("only_day")).otherwise(0)
    decisive = F.when(F.col("order") == "day first", F.col("only_day")).when(F.col("order") == "month first", F.col("only_month")).otherwise(0)
    read = votes.withColumn("all", F.sum("n").over(total)).where(F.col("shape").isNotNull()).withColumn("order", order) \
        .withColumn("decisive", decisive).withColumn("n", F.col("n") - lost)
    best = F.row_number().over(total.orderBy(F.desc("n"), "shape")) == 1
    return read.select("column", F.col("shape").alias("format"), "order", "n", "decisive",
                       rnd(F.col("n") / F.col("all"), 4).alias("share"), best.alias("chosen"))
