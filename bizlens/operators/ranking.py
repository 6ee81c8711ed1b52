"""Exact, distributed order statistics: running sums, quantiles, average-rank AUC.

A running sum along an order is a window with no natural partition key; written
naively (``Window.orderBy``) Spark moves every row into one task.  Here it is a
two-level prefix sum:

1. rows are first collapsed to distinct ``(group, value)`` with their weights
   (partial aggregation -- a heavy value is one row, never a hot task);
2. groups larger than ``rows_per_bucket`` are cut into ordered range buckets
   whose bounds come from ``percentile_approx`` and are compiled into a
   binary-search CASE expression (a pure function of the row, so it is stable
   under recomputation and executor loss);
3. running sums are computed inside each ``(group, bucket)`` window, and bucket
   offsets from a tiny ``(group, bucket)`` totals table (size known on the
   driver: broadcast with a proven bound).

The result is exact; only the *balance* of buckets depends on the approximate bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import bounded_broadcast

DEFAULT_ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 4096         # bounds compiled into the bucket CASE, all groups together
ROWS_PER_BUCKET_CONF = "bizlens.ranking.rowsPerBucket"
_UNB = Window.unboundedPreceding


def _rows_per_bucket(df: DataFrame, given: int | None) -> int:
    """Bucket size: explicit argument, else the session setting, else 2M rows."""
    if given is not None:
        return given
    return int(df.sparkSession.conf.get(ROWS_PER_BUCKET_CONF, str(DEFAULT_ROWS_PER_BUCKET)))


def _bsearch(v: Column, bounds: list, lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(v < F.lit(bounds[mid]), _bsearch(v, bounds, lo, mid)) \
        .otherwise(_bsearch(v, bounds, mid + 1, hi))


def _group_match(part_cols: Sequence[str], row) -> Column:
    cond = F.lit(True)
    for c in part_cols:
        val = row[c]
        cond = cond & (F.col(c).isNull() if val is None else (F.col(c) == F.lit(val)))
    return cond


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner", broadcast_right: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (grouping-set keys)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in keys],
                     *[c for c in right.columns if c not in keys])   # keeps a broadcast hint of ``right``
    if broadcast_right:
        r = F.broadcast(r)
    cond = None
    for c in keys:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in keys])


def bucket_column(df: DataFrame, order_col: str, part_cols: Sequence[str],
                  rows_per_bucket: int) -> Column | None:
    """Ordered range bucket per group; None when every group fits one bucket.

    Two small jobs whatever the number of groups: the oversized groups (one row
    each), then the bounds of all of them in a single ``percentile_approx``
    aggregate over a common probability grid.  The total bucket count is held
    to ``MAX_BUCKETS`` by widening the buckets, so the compiled CASE has a
    fixed size on any input (larger buckets only mean longer window partitions,
    which spill)."""
    part_cols = list(part_cols)
    sizes = df.groupBy(*part_cols).count().where(F.col("count") > rows_per_bucket).collect()
    if not sizes:
        return None
    rows_per_bucket = max(rows_per_bucket, math.ceil(sum(r["count"] for r in sizes) / MAX_BUCKETS))
    nbs = {tuple(r[c] for c in part_cols): math.ceil(r["count"] / rows_per_bucket) for r in sizes}
    grid = max(nbs.values())
    if grid < 2:
        return None
    sub = df
    if part_cols:
        # only groups that are cut: the quantiles collected are (cut groups) x (grid)
        big = df.sparkSession.createDataFrame([k for k, nb in nbs.items() if nb > 1], df.select(*part_cols).schema)
        sub = join_null_safe(df, big, part_cols, "left_semi", broadcast_right=True)
    probs = [i / grid for i in range(1, grid)]
    accuracy = max(10_000, 10 * grid)
    found = sub.groupBy(*part_cols).agg(F.percentile_approx(order_col, probs, accuracy).alias("_q")).collect()
    expr = None
    for row in found:
        nb = nbs.get(tuple(row[c] for c in part_cols), 1)   # a NaN key matches no entry: one bucket
        if nb < 2:
            continue
        # group bounds at k/nb, read off the common grid (index j is quantile (j+1)/grid)
        bounds = sorted(row["_q"][round(k * grid / nb) - 1] for k in range(1, nb))
        cond = _group_match(part_cols, row)
        b = _bsearch(F.col(order_col), bounds, 0, len(bounds))
        expr = F.when(cond, b) if expr is None else expr.when(cond, b)
    return None if expr is None else expr.otherwise(F.lit(0))


def prefix_sums(df: DataFrame, order_col: str, weights: Sequence[str],
                part_cols: Sequence[str] = (), descending: bool = False,
                rows_per_bucket: int | None = None) -> DataFrame:
    """Adds ``<w>_below``: sum of ``w`` over rows strictly before this one along
    ``order_col`` (numeric) within ``part_cols``.  Rows must be unique per
    ``(part_cols, order_col)``."""
    part_cols = list(part_cols)
    rows_per_bucket = _rows_per_bucket(df, rows_per_bucket)
    key = (-F.col(order_col)) if descending else F.col(order_col)
    x = df.withColumn("_k", key)
    bucket = bucket_column(x, "_k", part_cols, rows_per_bucket)
    if bucket is None:
        # every group fits one bucket: a plain running sum per group, no offsets
        w = Window.partitionBy(*part_cols).orderBy("_k").rowsBetween(_UNB, -1)
        return x.select(*df.columns, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_below")
                                       for c in weights])
    x = x.withColumn("_b", bucket)
    local_w = Window.partitionBy(*part_cols, "_b").orderBy("_k").rowsBetween(_UNB, -1)
    x = x.select("*", *[F.coalesce(F.sum(w).over(local_w), F.lit(0)).alias(f"_{w}_loc")
                        for w in weights])
    tot = x.groupBy(*part_cols, "_b").agg(*[F.sum(w).alias(f"_{w}_bt") for w in weights])
    off_w = Window.partitionBy(*part_cols).orderBy("_b").rowsBetween(_UNB, -1)
    off = tot.select(*part_cols, "_b", *[F.coalesce(F.sum(f"_{w}_bt").over(off_w), F.lit(0))
                                         .alias(f"_{w}_off") for w in weights])
    # ``off`` has a row for every group and bucket: broadcast under a checked size, else shuffled
    y = join_null_safe(x, bounded_broadcast(off), [*part_cols, "_b"])
    return y.select(*df.columns, *[(F.col(f"_{w}_off") + F.col(f"_{w}_loc")).alias(f"{w}_below")
                                   for w in weights])


def order_statistics(df: DataFrame, value_col: str, picks: dict[str, Callable[[Column], Column]],
                     part_cols: Sequence[str] = (),
                     rows_per_bucket: int | None = None, counted: str | None = None) -> DataFrame:
    """For each group, the values at 0-based ranks ``picks[name](N)`` (ascending,
    nulls excluded).  Returns ``part_cols + [n] + picks``.  With ``counted`` the rows are
    distinct per group and value already and that column holds how often each occurs."""
    part_cols = list(part_cols)
    counts = df.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
    if counted:
        counts = counts.select(*part_cols, value_col, F.col(counted).alias("_n"))
    else:
        counts = counts.groupBy(*part_cols, value_col).agg(F.count(F.lit(1)).alias("_n"))
    ps = prefix_sums(counts, value_col, ["_n"], part_cols, rows_per_bucket=rows_per_bucket)
    if part_cols:
        totals = counts.groupBy(*part_cols).agg(F.sum("_n").alias("n"))
        # one row a group: under a checked size the distinct values of a column are not gathered for it
        j = join_null_safe(ps, bounded_broadcast(totals), part_cols)
    else:  # one group: its size is a scalar subquery, no join at all
        n_all = F.coalesce(counts.agg(F.sum("_n")).scalar(), F.lit(0).cast("bigint"))
        j = ps.withColumn("n", n_all)
    hit = None
    sel = []
    for name, f in picks.items():
        k = f(F.col("n"))
        inside = (F.col("_n_below") <= k) & (k < F.col("_n_below") + F.col("_n"))
        hit = inside if hit is None else hit | inside
        sel.append(F.max(F.when(inside, F.col(value_col))).alias(name))
    if part_cols:
        found = j.where(hit).groupBy(*part_cols).agg(*sel)
        return join_null_safe(totals, found, part_cols, "left")
    return j.where(hit).agg(*sel).select(n_all.alias("n"), *picks.keys())


def quantiles(df: DataFrame, value_col: str, qs: dict[str, float], part_cols: Sequence[str] = (),
              rows_per_bucket: int | None = None, counted: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/NumPy default)."""
    picks = {}
    for name, q in qs.items():
        picks[f"_{name}_lo"] = (lambda q: lambda n: F.floor((n - 1) * F.lit(q)))(q)
        picks[f"_{name}_hi"] = (lambda q: lambda n: F.ceil((n - 1) * F.lit(q)))(q)
    st = order_statistics(df, value_col, picks, part_cols, rows_per_bucket, counted)
    out = [*part_cols, "n"]
    for name, q in qs.items():
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        frac = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
        out.append((lo + (hi - lo) * frac).alias(name))
    return st.select(*out)


def rank_auc(long_df: DataFrame, score_col: str, label_col: str,
             part_cols: Sequence[str] = (),
             rows_per_bucket: int | None = None, counted: str | None = None) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties, per group; 0.5 when a class
    is empty; NULL/NaN scores are dropped (pairwise deletion).  Exact integer
    arithmetic: 2U = sum_pos(2*below + n + 1) - P(P+1).  With ``counted`` a row stands for as many
    as that column holds."""
    part_cols = list(part_cols)
    s = F.col(score_col)
    valid = s.isNotNull() & ~F.isnan(s.cast("double"))
    # masked scores collapse to one NULL row per group: the group still gets a row
    # (AUC 0.5, both classes empty) when none of its scores survive the mask
    n = F.lit(1) if counted is None else F.col(counted)
    g_all = long_df.groupBy(*part_cols, F.when(valid, s).alias(score_col)).agg(
        F.sum(n).alias("_n"), F.sum(F.col(label_col).cast("long") * n).alias("_pos"))
    g = g_all.where(F.col(score_col).isNotNull())
    ps = prefix_sums(g, score_col, ["_n"], part_cols, rows_per_bucket=rows_per_bucket)
    a = ps.groupBy(*part_cols).agg(
        F.sum(F.col("_pos") * (2 * F.col("_n_below") + F.col("_n") + 1)).alias("_s"),
        F.sum("_pos").alias("_P"), F.sum("_n").alias("_N"))
    if part_cols:
        a = join_null_safe(g_all.select(*part_cols).distinct(), a, part_cols, "left")
    a = a.select(*part_cols, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("_s", "_P", "_N")])
    neg = F.col("_N") - F.col("_P")
    two_u = F.col("_s") - F.col("_P") * (F.col("_P") + 1)
    auc = F.when((F.col("_P") == 0) | (neg == 0), F.lit(0.5)) \
        .otherwise(two_u.cast("double") / (2 * F.col("_P") * neg).cast("double"))
    return a.select(*part_cols, auc.alias("auc"), F.col("_P").alias("n_pos"), neg.alias("n_neg"))
