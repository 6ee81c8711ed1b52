"""Validity gate (family B): duplicates, leakage scan by rank AUC, class-pure
columns and levels, trivial baselines, verdict.

Every column check is one long-format job partitioned by column name, fed by the
same ``(column, value)`` aggregation the profiler uses; AUCs of all eligible
columns come from a single ``rank_auc`` pass grouped by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import position, positional, quoted
from ..functions.numeric import rnd
from .profile import DATE_TYPES, duplicate_rows, is_numeric, long_cell, long_values
from .ranking import rank_auc

LEAK_AUC_THRESHOLD = 0.90
MAX_TEXT_LEVELS = 30      # text columns coded for the leakage scan
MAX_PURE_LEVELS = 20      # columns tested for class purity
SCREEN_MAX_LIMIT = 200    # level limits the 512-register sketch screen decides exactly


def is_coded(dt: T.DataType) -> bool:
    """Types whose few levels are scored by their code: text, and dates as text."""
    return isinstance(dt, (T.StringType, *DATE_TYPES))


def low_cardinality_levels(df: DataFrame, cols: list[str], limit: int) -> dict[str, list[str]]:
    """The sorted levels (as text) of every column among ``cols`` with at most
    ``limit`` distinct non-missing values, decided exactly without shuffling the
    values of wide columns.

    One wide aggregate first takes an HLL++ estimate of every column (sketches merge
    map-side, no value leaves its task).  With rsd 0.05 a sketch has m = 512
    registers and reads linear counting up to 400; n values fill at most n
    registers, so a column with n <= ``limit`` values is estimated at most
    m ln(m / (m - n)) (30.9 for n = 30), below ``2 * limit``.  Only columns under
    that bound get the exact pass, whose (column, value) shuffle carries a few dozen
    rows per task at any scale; it returns the values of the columns whose exact
    count is within ``limit`` (at most ``limit`` rows per column reach the driver).
    (A finer sketch would be no more exact and costs seconds of code generation
    per column: the registers are inlined into the aggregation buffer.)"""
    if not cols:
        return {}
    plain, label = positional(df)
    fields = {label[f.name]: f for f in plain.schema.fields}
    cand = list(cols)
    if limit <= SCREEN_MAX_LIMIT:
        est = plain.agg(*[F.approx_count_distinct(long_cell(fields[c]), 0.05).alias(f"e{i}")
                       for i, c in enumerate(cols)]).first()
        cand = [c for i, c in enumerate(cols) if est[f"e{i}"] <= 2 * limit]
    if not cand:
        return {}
    vals = long_values(df, cand).distinct()
    names = df.sparkSession.createDataFrame([(c,) for c in cand], "column string")
    n = names.join(vals.groupBy("column").agg(F.count(F.lit(1)).alias("n")), "column", "left")
    small = n.where(F.coalesce(F.col("n"), F.lit(0)) <= limit).select("column")
    levels: dict[str, list[str]] = {}
    for r in small.join(vals, "column", "left").collect():
        got = levels.setdefault(r["column"], [])
        if r["value"] is not None:
            got.append(r["value"])
    return {c: sorted(v) for c, v in levels.items()}


def low_cardinality(df: DataFrame, cols: list[str], limit: int) -> set[str]:
    """The columns among ``cols`` with at most ``limit`` distinct non-missing values."""
    return set(low_cardinality_levels(df, cols, limit))


def shared_levels(df: DataFrame, target: str) -> dict[str, list[str]]:
    """One level check for a whole validity report: the leakage scan's text codes
    (<= 30 levels) and the purity check's columns (<= 20) both read it, so the table
    is screened once instead of twice."""
    return low_cardinality_levels(df, [c for c in df.columns if c != target],
                                  max(MAX_TEXT_LEVELS, MAX_PURE_LEVELS))


def leakage_long(df: DataFrame, target: str, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """(column, score, y): numeric columns as they are; text columns with at most
    30 levels as their lexicographic code, NULL text coded -1 (and ranked).  One
    scan: the level lists come back from the exact level check (<= 30 each), so a
    text code is a literal CASE over them (no dictionary scan, window or join), and
    all scores are exploded to long form at once."""
    y = position(df, target)
    plain, label = positional(df)
    fields = [f for f in plain.schema.fields if f.name != y]
    text = [label[f.name] for f in fields if is_coded(f.dataType)]
    coded = low_cardinality_levels(df, text, MAX_TEXT_LEVELS) if levels is None else \
        {c: v for c, v in levels.items() if c in text and len(v) <= MAX_TEXT_LEVELS}
    cells = []
    for f in fields:
        if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType):
            # a boolean scores as 0 and 1
            number = F.col(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
            cells.append(F.struct(F.lit(label[f.name]).alias("column"), number.cast("double").alias("score")))
        elif label[f.name] in coded:
            c, code = long_cell(f), F.lit(-1)
            for i, v in reversed(list(enumerate(coded[label[f.name]]))):
                code = F.when(c == F.lit(v), F.lit(i)).otherwise(code)
            cells.append(F.struct(F.lit(label[f.name]).alias("column"), code.cast("double").alias("score")))
    empty = F.array().cast("array<struct<column:string,score:double>>")
    return plain.select(F.col(y).alias("y"), F.explode(F.array(*cells) if cells else empty).alias("c")) \
        .select("c.column", "c.score", "y")


def leakage_scan(df: DataFrame, target: str, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Univariate AUC of every eligible column, direction-free, flagged at >= 0.90."""
    a = rank_auc(leakage_long(df, target, levels), "score", "y", ["column"])
    both = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return a.select("column", rnd(both, 4).alias("univariate_auc"),
                    (both >= LEAK_AUC_THRESHOLD).alias("flagged"))


def _pure_levels(df: DataFrame, target: str, levels: dict[str, list[str]] | None = None) -> DataFrame:
    cols = [c for c in df.columns if c != target]
    eligible = low_cardinality(df, cols, MAX_PURE_LEVELS) if levels is None else \
        {c for c, v in levels.items() if c in cols and len(v) <= MAX_PURE_LEVELS}
    y = position(df, target)
    plain, label = positional(df)
    fields = [f for f in plain.schema.fields if label[f.name] in eligible]
    cells = F.array(*[F.struct(F.lit(label[f.name]).alias("column"), long_cell(f).alias("value")) for f in fields]) \
        if fields else F.array().cast("array<struct<column:string,value:string>>")
    long = plain.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), F.explode(cells).alias("c")) \
        .select("c.column", "c.value", "y").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def one_sided_columns(df: DataFrame, target: str, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns with <= 20 levels where both classes occur among their non-null rows
    and every level occurs in one class only (the code's definition)."""
    lv = _pure_levels(df, target, levels)
    g = lv.groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"),
                                 F.bool_and(F.col("ymin") == F.col("ymax")).alias("all_pure"),
                                 # of pure levels: exactly two classes; an impure level decides alone
                                 F.count_distinct("ymin").alias("classes"))
    return g.select("column", "n_levels", (F.col("all_pure") & (F.col("classes") == 2)).alias("one_sided"))


def one_sided_levels(df: DataFrame, target: str) -> DataFrame:
    lv = _pure_levels(df, target)
    return lv.where(F.col("ymin") == F.col("ymax")).select("column", "value", F.col("ymin").alias("only_class"))


def baselines(df: DataFrame, target: str) -> DataFrame:
    a = df.agg(F.avg(F.col(quoted(target)).cast("double")).alias("p"))
    return a.select(rnd(F.greatest("p", 1 - F.col("p")), 4).alias("majority_class_accuracy"),
                    rnd("p", 4).alias("positive_rate"), F.lit(0.5).alias("random_auc"))


def crosstab(df: DataFrame, col: str, target: str) -> DataFrame:
    """Counts of every level of ``col`` with every class of ``target``, in long form."""
    level, y = F.col(position(df, col)), F.col(position(df, target))
    return positional(df)[0].where(level.isNotNull() & y.isNotNull()).groupBy(
        level.cast("string").alias("value"), y.cast("string").alias("class")) \
        .agg(F.count(F.lit(1)).alias("n"))


def validity_verdict(df: DataFrame, target: str) -> DataFrame:
    dup = duplicate_rows(df).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))
    levels = shared_levels(df, target)
    sus = leakage_scan(df, target, levels).where("flagged").agg(F.count(F.lit(1)).alias("n_suspects"))
    one = one_sided_columns(df, target, levels).where("one_sided").agg(F.count(F.lit(1)).alias("n_one_sided"))
    n = df.agg(F.count(F.lit(1))).scalar()
    s, o = sus.scalar(), one.scalar()
    d = dup.scalar()
    verdict = F.when((s == 0) & (o == 0), "clean").otherwise("review_required")
    return df.sparkSession.range(1).select(
        n.alias("n_rows"), d.cast("bigint").alias("duplicate_rows"), s.alias("n_suspects"),
        o.alias("n_one_sided"), verdict.alias("verdict"))


def validity_report(df: DataFrame, target: str) -> DataFrame:
    """Text rendering of the gate (C8): one row per line, built from the aggregated
    check results only (a handful of rows)."""
    from pyspark.sql import Window
    n = df.agg(F.count(F.lit(1))).scalar()
    dup = duplicate_rows(df).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    b = baselines(df, target)
    spark = df.sparkSession
    head = b.select(
        F.explode(F.array(
            F.struct(F.lit(1).alias("line_no"),
                     F.concat(n.cast("string"), F.lit(" rows, "), dup.cast("string"), F.lit(" of them members of duplicate sets"))
                     .alias("text")),
            F.struct(F.lit(2).alias("line_no"),
                     F.concat(F.lit("A constant guess reaches accuracy "),
                              F.col("majority_class_accuracy").cast("string"),
                              F.lit(" and AUC 0.5; share of positives "), F.col("positive_rate").cast("string"),
                              F.lit(".")).alias("text")))).alias("l")).select("l.*")
    levels = shared_levels(df, target)
    scan = leakage_scan(df, target, levels).where("flagged")
    # suspects and class-pure columns are per-column results: a few rows at most
    sus = scan.select((F.lit(10) + F.row_number().over(
        Window.orderBy(F.desc("univariate_auc"), "column"))).alias("line_no"),
        F.concat(F.lit("* "), F.col("column"), F.lit(": AUC "),
                 F.col("univariate_auc").cast("string")).alias("text"))
    n_sus = scan.agg(F.count(F.lit(1))).scalar()
    sus_head = spark.range(1).where(n_sus > 0).select(
        F.lit(10).alias("line_no"),
        F.lit("Columns that rank the target almost without error by themselves:").alias("text"))
    one = one_sided_columns(df, target, levels).where("one_sided")
    one_line = one.agg(F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("cols"),
                       F.count(F.lit(1)).alias("k")).where(F.col("k") > 0).select(
        F.lit(1000).alias("line_no"),
        F.concat(F.lit("Columns whose every level belongs to one class: "), F.col("cols")).alias("text"))
    n_one = one.agg(F.count(F.lit(1))).scalar()
    clean = spark.range(1).where((n_sus == 0) & (n_one == 0)).select(
        F.lit(2000).alias("line_no"), F.lit("No column gives the target away.").alias("text"))
    return head.unionByName(sus_head).unionByName(sus).unionByName(one_line).unionByName(clean)
