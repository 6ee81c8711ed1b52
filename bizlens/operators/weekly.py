"""Weekly operating metrics over the ``wk`` fact (family D and the marketplace part
of family E).

Plan shape: the fact is already at week x category x region x channel grain
(thousands of rows per year, independent of order volume), so every report here
is one partial/final hash aggregate on that grain followed by windows over
(segment, week) on a few hundred rows per segment.  Dense grids are produced by
exploding the (small, bounded) level list per week -- no cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import (EXTRA, KPI_DELTAS, MONEY_SUMS, RATIOS, SUMS, TREND, Watch,
                                 lower_is_better, measure_aggs, metric_col, ratio_col)
from ..functions.numeric import dbl, rnd
from .ranking import join_null_safe

ALL_MEASURES = SUMS + list(EXTRA)
FLAT_BAND = 0.005


def aggregate(wk: DataFrame, by: list[str]) -> DataFrame:
    return wk.groupBy(*by).agg(*measure_aggs())


def measure_columns() -> dict:
    """The additive measures as expressions over a row of the fact."""
    return {m: F.col(m) for m in SUMS} | {m: f() for m, f in EXTRA.items()}


def project(df: DataFrame, keys: list[str], measures: list[str] = (),
            ratios: list[str] = ()) -> DataFrame:
    """Output projection: money to 4 dp doubles, counts as longs, ratios to 6 dp."""
    cols = [F.col(k) for k in keys]
    for m in measures:
        cols.append(rnd(m, 4).alias(m) if m in MONEY_SUMS else F.col(m).cast("bigint").alias(m))
    for r in ratios:
        cols.append(rnd(ratio_col(r), 6).alias(r))
    return df.select(*cols)


def with_week_index(df: DataFrame, weeks: DataFrame) -> DataFrame:
    return df.join(F.broadcast(weeks.select("week", "week_idx")), "week")   # calendar-bounded


def dense_grid(agg: DataFrame, weeks: DataFrame, dim: str, with_all: bool = False) -> DataFrame:
    """Every present week x every level of ``dim``; absent cells get zero measures.
    The level list is a bounded scalar (one array), exploded per week: no join fan-out.
    With ``with_all`` the input also carries the all-levels rows (``dim`` NULL, from
    grouping sets) and the grid gets that level too."""
    levels = agg.where(F.col(dim).isNotNull()).agg(F.array_sort(F.collect_set(dim))).scalar()
    if with_all:
        levels = F.concat(levels, F.array(F.lit(None).cast("string")))
    grid = weeks.select("week", "week_idx", F.explode(levels).alias(dim))
    filled = join_null_safe(grid, agg, ["week", dim], "left") if with_all \
        else grid.join(agg, ["week", dim], "left")
    return filled.select("week", "week_idx", dim,
                         *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in ALL_MEASURES])


def aggregate_with_all(wk: DataFrame, dim: str) -> DataFrame:
    """Per (week, level) and per week over all levels (``dim`` NULL) in one pass."""
    return wk.groupingSets([["week", dim], ["week"]], "week", dim).agg(*measure_aggs())


def weekly_measures(wk: DataFrame) -> DataFrame:
    return project(aggregate(wk, ["week"]), ["week"], ALL_MEASURES)


def weekly_ratios(wk: DataFrame) -> DataFrame:
    return project(aggregate(wk, ["week"]), ["week"], [], list(RATIOS))


def paid_cac(wk: DataFrame) -> DataFrame:
    return project(aggregate(wk, ["week"]), ["week"], ["camp", "paid_camp", "paid_spend", "spend"],
                   ["paidShare", "paidCac"])


def latest_week(weeks: DataFrame, offset: int = 0):
    """Scalar subquery: the present week ``offset`` positions before the last one."""
    return weeks.where(F.col("week_idx") == weeks.agg(F.max("week_idx")).scalar() - offset) \
        .agg(F.max("week")).scalar()


def weekly_filter(wk: DataFrame, weeks: DataFrame, category=None, region=None,
                  channel=None) -> DataFrame:
    last = latest_week(weeks)
    rows = wk.where(F.col("week") == last)
    for c, v in (("category", category), ("region", region), ("channel", channel)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return project(rows.agg(*measure_aggs()), [], ALL_MEASURES, list(RATIOS))


def week_endpoints(wk: DataFrame, weeks: DataFrame) -> DataFrame:
    """First, previous and latest present week (W5), aggregated."""
    mx = weeks.agg(F.max("week_idx")).scalar()
    label = (F.when(F.col("week_idx") == mx, "last").when(F.col("week_idx") == mx - 1, "prev")
             .when(F.col("week_idx") == 0, "first"))
    x = with_week_index(wk, weeks).withColumn("endpoint", label).where(F.col("endpoint").isNotNull())
    return project(aggregate(x, ["endpoint"]), ["endpoint"], ["camp", "gdv", "rev", "tips", "don"],
                   ["takeRate", "tipRate"])


def fraud_early_late(wk: DataFrame, weeks: DataFrame, category: str, split_idx: int = 14) -> DataFrame:
    """Fraud rate of one category before/after a week split vs every other category
    (W6, E13), as conditional aggregates in a single scan."""
    x = with_week_index(wk, weeks)
    is_cat = F.col("category") == category
    early = is_cat & (F.col("week_idx") < split_idx)
    late = is_cat & (F.col("week_idx") >= split_idx)

    def rate(cond):
        return F.coalesce(F.try_divide(dbl(F.sum(F.when(cond, F.col("fraud")).otherwise(0))),
                                       dbl(F.sum(F.when(cond, F.col("camp")).otherwise(0)))),
                          F.lit(0.0))

    return x.agg(rnd(rate(early), 6).alias("fraud_early"), rnd(rate(late), 6).alias("fraud_late"),
                 rnd(rate(~is_cat), 6).alias("fraud_base"))


def wow_delta(wk: DataFrame, weeks: DataFrame, dim: str = "region",
              metrics: list[str] = KPI_DELTAS) -> DataFrame:
    """Week-over-week change per segment and for all segments (``dim`` NULL)
    on the dense grid: NULL when the previous week is missing or zero; flat below
    0.5 %; lower-is-better flipped."""
    grid = dense_grid(aggregate_with_all(wk, dim), weeks, dim, with_all=True)
    vals = grid.select("week", "week_idx", dim, *[metric_col(m).alias(m) for m in metrics])
    long = vals.select("week", "week_idx", dim, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"),
                 F.lit(lower_is_better(m)).alias("invert")) for m in metrics])).alias("m")) \
        .select("week", "week_idx", dim, "m.*")
    w = Window.partitionBy(dim, "metric").orderBy("week_idx")
    prev = F.lag("value").over(w)
    x = long.withColumn("prev", prev).withColumn(
        "delta", F.when(F.col("prev") != 0, (F.col("value") - F.col("prev")) / F.col("prev")))
    direction = (F.when(F.col("delta").isNull(), None)
                 .when(F.abs("delta") < FLAT_BAND, "flat")
                 .when(F.col("invert") != (F.col("delta") > 0), "up").otherwise("down"))
    return x.select("week", dim, "metric", rnd("value", 6).alias("value"),
                    rnd("prev", 6).alias("prev"), rnd("delta", 6).alias("delta"),
                    direction.alias("direction"))


CUBE_DIMS = ["category", "region", "channel"]


def filter_sets() -> list[list[str]]:
    """(week + every subset of the filter dimensions): one grouping set per filter combination."""
    return [["week"] + [d for i, d in enumerate(CUBE_DIMS) if not (mask >> (2 - i)) & 1] for mask in range(8)]


def dense_cube(wk: DataFrame, weeks: DataFrame) -> DataFrame:
    """Every present week x every filter combination that occurs (``gid`` marks the "All" levels); a
    combination's empty weeks have zero measures."""
    a = wk.groupingSets(filter_sets(), "week", *CUBE_DIMS).agg(F.grouping_id().cast("bigint").alias("gid"), *measure_aggs())
    key = ["gid", *CUBE_DIMS]
    # one array of present weeks (calendar-bounded), exploded per combination
    every_week = weeks.agg(F.array_sort(F.collect_set(F.struct("week", "week_idx")))).scalar()
    grid = a.select(*key).distinct().select(*key, F.explode(every_week).alias("w")).select(*key, "w.week", "w.week_idx")
    filled = join_null_safe(grid, a, ["week", *key], "left")
    return filled.select("week", "week_idx", *key, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in ALL_MEASURES])


def wow_cube(wk: DataFrame, weeks: DataFrame, metrics: list[str] = KPI_DELTAS) -> DataFrame:
    """The week-over-week change of every KPI under every filter combination (N2 with the filters of the report):
    all metrics lag in one window, one column each."""
    x = dense_cube(wk, weeks).select("week", "week_idx", "gid", *CUBE_DIMS, *[metric_col(m).alias(m) for m in metrics])
    w = Window.partitionBy("gid", *CUBE_DIMS).orderBy("week_idx")
    x = x.select("*", *[F.lag(m).over(w).alias(f"_p_{m}") for m in metrics])
    return x.select("week", "gid", *CUBE_DIMS, *[
        rnd(F.when(F.col(f"_p_{m}") != 0, (F.col(m) - F.col(f"_p_{m}")) / F.col(f"_p_{m}")), 6).alias(f"wow_{m}")
        for m in metrics])


def trailing_cube(wk: DataFrame, weeks: DataFrame) -> DataFrame:
    """The trailing mean of up to four weeks (N3) under every filter combination."""
    w = Window.partitionBy("gid", *CUBE_DIMS).orderBy("week_idx").rowsBetween(-4, -1)
    return dense_cube(wk, weeks).select("week", "gid", *CUBE_DIMS, *[
        rnd(F.avg(dbl(m)).over(w), 4).alias(f"{m}_4wk") for m in ("gdv", "rev", "camp", "don")])


def wow_by_segment(wk: DataFrame, weeks: DataFrame, dim: str = "category") -> DataFrame:
    """Current vs previous present week per segment (J4); absent previous = 0."""
    grid = dense_grid(aggregate(wk, ["week", dim]), weeks, dim)
    w = Window.partitionBy(dim).orderBy("week_idx")
    x = grid.select("week", dim, "camp", dbl("gdv").alias("gdv"),
                    F.lag(dbl("gdv")).over(w).alias("prev_gdv"),
                    F.lag("camp").over(w).alias("prev_camp")).where(F.col("camp") > 0)
    return x.select("week", dim, "camp", "prev_camp", rnd("gdv", 4).alias("gdv"),
                    rnd("prev_gdv", 4).alias("prev_gdv"),
                    rnd(F.when(F.col("prev_gdv") != 0, (F.col("gdv") - F.col("prev_gdv"))
                               / F.col("prev_gdv")), 6).alias("wow_gdv"))


def weekly_dense_trend(wk: DataFrame, weeks: DataFrame, dim: str = "region") -> DataFrame:
    grid = dense_grid(aggregate(wk, ["week", dim]), weeks, dim)
    return project(grid, ["week", dim], ["camp", "gdv", "rev", "don"], ["takeRate"])


def trailing_4wk(wk: DataFrame, weeks: DataFrame, dim: str = "region") -> DataFrame:
    """Mean of up to four previous present weeks, current excluded (N3); empty weeks
    count as zero, NULL at the first week.  ``dim`` NULL = all levels."""
    grid = dense_grid(aggregate_with_all(wk, dim), weeks, dim, with_all=True)
    w = Window.partitionBy(dim).orderBy("week_idx").rowsBetween(-4, -1)
    return grid.select("week", dim, *[rnd(F.avg(dbl(m)).over(w), 4).alias(f"{m}_4wk")
                                      for m in ("gdv", "rev", "camp", "don")])


def trend(wk: DataFrame) -> DataFrame:
    """All weeks, the seven selectable metrics, from one aggregate."""
    a = aggregate(wk, ["week"])
    return a.select("week", *[rnd(metric_col(m), 6).alias(m) for m in TREND])


def take_rate_split(wk: DataFrame) -> DataFrame:
    return project(aggregate(wk, ["week"]), ["week"], [], ["tipRate", "procRate", "takeRate"])


def trust_by_category(wk: DataFrame) -> DataFrame:
    a = aggregate(wk, ["week", "category"]).where(F.col("camp") > 0)
    return project(a, ["week", "category"], ["camp"], ["refundRate", "fraudRate"])


def channel_cac(wk: DataFrame) -> DataFrame:
    a = aggregate(wk, ["week", "channel"])
    return a.select("week", "channel", F.col("camp").cast("bigint").alias("camp"),
                    F.col("spend").cast("bigint").alias("spend"),
                    rnd(F.coalesce(F.try_divide(dbl("spend"), dbl("camp")), F.lit(0.0)), 6)
                    .alias("cost_per_campaign"))


def segment_table(wk: DataFrame, weeks: DataFrame, dim: str = "category",
                  warn_refund: float = 0.012) -> DataFrame:
    """Per week, the segments with campaigns, GDV share of the week, rates and WoW
    GDV (N5); ``seg_rank`` orders by GDV descending."""
    grid = dense_grid(aggregate(wk, ["week", dim]), weeks, dim)
    w = Window.partitionBy(dim).orderBy("week_idx")
    x = grid.withColumn("prev_gdv", F.lag(dbl("gdv")).over(w)).where(F.col("camp") > 0)
    wk_total = Window.partitionBy("week")
    share = dbl("gdv") / F.sum(dbl("gdv")).over(wk_total)
    rank = F.row_number().over(Window.partitionBy("week").orderBy(F.desc("gdv"), dim))
    return x.select(
        "week", dim, rank.alias("seg_rank"), rnd("gdv", 4).alias("gdv"),
        rnd(share, 6).alias("share"),
        *[rnd(ratio_col(r), 6).alias(r) for r in
          ("takeRate", "avgDonation", "fundedRate", "repeatDonor", "refundRate")],
        (ratio_col("refundRate") > warn_refund).alias("refund_warn"),
        rnd(F.when(F.col("prev_gdv") != 0, (dbl("gdv") - F.col("prev_gdv")) / F.col("prev_gdv")), 6)
        .alias("wow_gdv"))


def movers(wk: DataFrame, weeks: DataFrame, watch: list[Watch], top: int = 7) -> DataFrame:
    """Watched metrics x segment, guarded on both weeks, ranked by |relative change|,
    top ``top`` per week (N6, W10).  One dense grid per dimension (not per metric);
    all metrics of a dimension go long and share a single lag window."""
    parts = []
    for dim in dict.fromkeys(w.dim for w in watch):
        specs = [w for w in watch if w.dim == dim]
        grid = dense_grid(aggregate(wk, ["week", dim]), weeks, dim)
        long = grid.select("week", "week_idx", F.col(dim).alias("segment"), F.explode(F.array(*[
            F.struct(F.lit(sp.label).alias("metric"), metric_col(sp.metric).alias("now"),
                     dbl(sp.guard_measure).alias("g"), F.lit(float(sp.guard_min)).alias("gmin"),
                     F.lit(lower_is_better(sp.metric)).alias("invert"))
            for sp in specs])).alias("m")).select("week", "week_idx", "segment", "m.*")
        w = Window.partitionBy("segment", "metric").orderBy("week_idx")
        x = long.select("*", F.lag("now").over(w).alias("before"), F.lag("g").over(w).alias("g_prev"))
        x = x.where((F.col("week_idx") > 0) & (F.col("before") != 0)
                    & (F.col("g") >= F.col("gmin")) & (F.col("g_prev") >= F.col("gmin")))
        parts.append(x.select("week", "segment", F.lit(dim).alias("dim"), "metric", "now",
                              ((F.col("now") - F.col("before")) / F.col("before")).alias("d"), "invert"))
    allm = parts[0]
    for p in parts[1:]:
        allm = allm.unionByName(p)
    r = F.row_number().over(Window.partitionBy("week").orderBy(F.desc(F.abs("d")), "segment", "metric"))
    ranked = allm.withColumn("mover_rank", r).where(F.col("mover_rank") <= top)
    bad = F.when(F.col("invert"), F.col("d") > 0).otherwise(F.col("d") < 0)
    return ranked.select("week", "mover_rank", "segment", "dim", "metric", rnd("now", 6).alias("now"),
                         rnd("d", 6).alias("change"), F.when(bad, "bad").otherwise("good").alias("tone"))


def first_last_growth(wk: DataFrame, weeks: DataFrame) -> DataFrame:
    """Latest vs first present week: GDV/revenue growth, take and tip rate then and
    now, and the revenue forgone to tip compression (N8, E9)."""
    mx = weeks.agg(F.max("week_idx")).scalar()
    x = with_week_index(wk, weeks).where((F.col("week_idx") == 0) | (F.col("week_idx") == mx))
    a = x.groupBy().agg(
        F.sum(F.when(F.col("week_idx") == mx, F.col("gdv"))).alias("gdv"),
        F.sum(F.when(F.col("week_idx") == mx, F.col("rev"))).alias("rev"),
        F.sum(F.when(F.col("week_idx") == mx, F.col("tips"))).alias("tips"),
        F.sum(F.when(F.col("week_idx") == 0, F.col("gdv"))).alias("gdv0"),
        F.sum(F.when(F.col("week_idx") == 0, F.col("rev"))).alias("rev0"),
        F.sum(F.when(F.col("week_idx") == 0, F.col("tips"))).alias("tips0"))
    take_now = F.try_divide(dbl("rev"), dbl("gdv"))
    take_then = F.try_divide(dbl("rev0"), dbl("gdv0"))
    tip_now = F.try_divide(dbl("tips"), dbl("gdv"))
    tip_then = F.try_divide(dbl("tips0"), dbl("gdv0"))
    return a.select(
        rnd("gdv", 4).alias("gdv"), rnd("rev", 4).alias("rev"),
        rnd(take_now, 6).alias("take_now"), rnd(take_then, 6).alias("take_then"),
        rnd(tip_now, 6).alias("tip_now"), rnd(tip_then, 6).alias("tip_then"),
        rnd(F.try_divide(dbl("gdv"), dbl("gdv0")) - 1, 6).alias("gdv_growth"),
        rnd(F.try_divide(dbl("rev"), dbl("rev0")) - 1, 6).alias("rev_growth"),
        rnd(dbl("gdv") * (tip_then - tip_now), 4).alias("forgone"))


CATEGORY_RATES = {"fast": "fastRate", "funded": "fundedRate", "attain": "attainment",
                  "repeat_donor": "repeatDonor", "avg_don": "avgDonation",
                  "refund": "refundRate", "fraud": "fraudRate"}


def category_profile(wk: DataFrame) -> DataFrame:
    """Per-category rates over all weeks (A19): a plain aggregate, no group-apply."""
    a = aggregate(wk, ["category"])
    return a.select("category", *[rnd(ratio_col(r), 6).alias(k) for k, r in CATEGORY_RATES.items()],
                    rnd("gdv", 4).alias("gdv"))


def fast_attain_corr(wk: DataFrame) -> DataFrame:
    """Pearson correlation of the 24h-start rate and goal attainment across categories."""
    a = aggregate(wk, ["category"]).select(ratio_col("fastRate").alias("f"),
                                           ratio_col("attainment").alias("a"))
    return a.agg(rnd(F.corr("f", "a"), 6).alias("fast_attain_corr"),
                 F.count(F.lit(1)).alias("n_categories"))


def latest_kpis(wk: DataFrame, weeks: DataFrame, ratios: list[str]) -> DataFrame:
    last = latest_week(weeks)
    return project(wk.where(F.col("week") == last).agg(*measure_aggs()), [], ["camp", "gdv"], ratios)


def paid_vs_blended_cac(wk: DataFrame, weeks: DataFrame) -> DataFrame:
    last = latest_week(weeks)
    a = wk.where(F.col("week") == last).agg(*measure_aggs())
    return a.select(rnd(ratio_col("viralShare"), 6).alias("viral"),
                    rnd(ratio_col("paidShare"), 6).alias("paid_share"),
                    rnd(ratio_col("paidCac"), 6).alias("paid_cac"),
                    rnd(F.coalesce(F.try_divide(dbl("spend"), dbl("camp")), F.lit(0.0)), 6)
                    .alias("blended_cac"))


def weekly_cube_all(wk: DataFrame) -> DataFrame:
    """Every filter combination at once (A20): per week, CUBE over the three filter
    dimensions of the additive partials (the fact already is the base grain);
    ``gid`` (grouping_id bits category, region, channel) marks the "All" levels."""
    dims = CUBE_DIMS
    c = wk.groupingSets(filter_sets(), "week", *dims).agg(F.grouping_id().alias("gid"), *measure_aggs())
    c = c.withColumn("gid", F.col("gid").cast("bigint"))
    return project(c, ["week", *dims, "gid"], SUMS, list(RATIOS))
