"""Account-risk analytics over the ``acct`` view (family C): segment KPIs, dormancy
buckets, the outreach simulator and its whole threshold grid, top-N, top decile,
dictionaries and the compact account cube.

Scale: every KPI is a single partial/final aggregate.  The simulator grid is a
histogram over (capped dormancy, capped risk) -- at most 91 x 96 cells whatever
the account count -- followed by two suffix-sum windows on that small grid.
Medians and the top-decile cut go through ``ranking`` (exact, no single-task
window).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import dbl, js_round, money, rnd
from .ranking import order_statistics, prefix_sums, quantiles

CONTRACT_COLS = ["id", "plan", "region", "contract", "mrr", "dorm", "churned", "risk"]
# Dormancy buckets (inclusive bounds) and their labels.
DORM_BINS = [(0, 7, "0-7"), (8, 14, "8-14"), (15, 30, "15-30"), (31, 60, "31-60"),
             (61, None, "60+")]     # the last bucket is open
# Preferred contract order, the rest alphabetical after it.
PREFERRED_CONTRACTS = ["monthly", "quarterly", "annual", "multi-year"]
SEVERITY = [(0.15, "risk"), (0.06, "watch")]
GRID_DORM_MAX = 90
GRID_RISK_MAX = 95


def clean(acct: DataFrame) -> DataFrame:
    """Drop rows with a null in any contract column (W1); NaN counts as null."""
    x = acct.withColumn("mrr", F.nanvl(F.col("mrr"), F.lit(None).cast("double"))) \
        .withColumn("risk", F.nanvl(F.col("risk"), F.lit(None).cast("double")))
    return x.dropna(subset=CONTRACT_COLS).select(*CONTRACT_COLS)


def account_filter(acct: DataFrame, plan=None, region=None, contract=None) -> DataFrame:
    x = clean(acct)
    for c, v in (("plan", plan), ("region", region), ("contract", contract)):
        if v is not None:
            x = x.where(F.col(c) == v)
    return x


def _rate(num, den):
    return F.coalesce(F.try_divide(dbl(num), dbl(den)), F.lit(0.0))


def churn_by_plan(acct: DataFrame) -> DataFrame:
    a = clean(acct).groupBy("plan").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum("churned").cast("bigint").alias("churners"))
    rate = _rate("churners", "n")
    sev = F.when(rate > SEVERITY[0][0], SEVERITY[0][1]).when(rate > SEVERITY[1][0], SEVERITY[1][1]) \
        .otherwise("hold")
    return a.select("plan", "n", "churners", rnd(rate, 6).alias("churn_rate"), sev.alias("severity"))


def churn_by_plan_fixed(spark: SparkSession, acct: DataFrame, levels: list[str]) -> DataFrame:
    """Fixed display order; a listed level with no accounts gives NULLs (K5)."""
    order = spark.createDataFrame(list(enumerate(levels)), "pos int, plan string")
    a = clean(acct).groupBy("plan").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum("churned").cast("bigint").alias("churners"))
    j = order.join(a, "plan", "left")
    return j.select("pos", "plan", "n", rnd(F.try_divide(dbl("churners"), dbl("n")), 6).alias("churn_rate"))


def dormancy_bucket(col: str = "dorm"):
    c = F.col(col)
    expr = None
    for i, (lo, hi, label) in enumerate(DORM_BINS):
        cond = (c >= lo) & (c <= hi) if hi is not None else c >= lo
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def churn_by_dormancy(acct: DataFrame) -> DataFrame:
    x = clean(acct).withColumn("bin", dormancy_bucket()).where(F.col("bin").isNotNull())
    a = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("churned").cast("bigint").alias("churners"))
    label = None
    for i, (_, _, lab) in enumerate(DORM_BINS):
        label = F.when(F.col("bin") == i, lab) if label is None else label.when(F.col("bin") == i, lab)
    return a.select(F.col("bin").cast("int").alias("bin"), label.alias("bucket"), "n", "churners",
                    rnd(_rate("churners", "n"), 6).alias("churn_rate"))


def dormancy_cube(acct: DataFrame) -> DataFrame:
    """Dormancy buckets (A11) under every filter combination of plan, region and contract."""
    dims = ["plan", "region", "contract"]
    x = clean(acct).withColumn("bin", dormancy_bucket()).where(F.col("bin").isNotNull())
    sets = [["bin"] + [d for i, d in enumerate(dims) if not (mask >> (2 - i)) & 1] for mask in range(8)]
    a = x.groupingSets(sets, "bin", *dims).agg(
        F.grouping_id().cast("bigint").alias("gid"), F.count(F.lit(1)).alias("n"), F.sum("churned").cast("bigint").alias("churners"))
    return a.select(F.col("bin").cast("int").alias("bin"), "gid", *dims, "n", "churners",
                    rnd(_rate("churners", "n"), 6).alias("churn_rate"))


def outreach_at_threshold(acct: DataFrame, thresholds: list[tuple[int, float]]) -> DataFrame:
    """The simulator for a few (dormancy, risk) settings as conditional aggregates
    of one scan (A12, W8: inclusive predicates)."""
    x = clean(acct)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("churned").alias("churners")]
    for i, (d, r) in enumerate(thresholds):
        hit = (F.col("dorm") >= d) & (F.col("risk") >= F.lit(float(r)))
        aggs += [F.count_if(hit).alias(f"f{i}"), F.sum(F.when(hit, F.col("churned")).otherwise(0)).alias(f"c{i}"),
                 F.sum(F.when(hit, money("mrr"))).alias(f"m{i}")]
    a = x.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(d).alias("dorm_min"), F.lit(float(r)).alias("risk_min"),
                              F.col(f"f{i}").alias("flagged"), F.col(f"c{i}").alias("caught"),
                              F.col(f"m{i}").alias("mrr_covered"))
                     for i, (d, r) in enumerate(thresholds)])
    e = a.select("n", "churners", F.explode(rows).alias("t")).select("n", "churners", "t.*")
    return e.select("dorm_min", "risk_min", "flagged", rnd(_rate("flagged", "n"), 6).alias("share_flagged"),
                    F.col("caught").cast("bigint").alias("caught"),
                    rnd(_rate("caught", "churners"), 6).alias("capture"),
                    rnd(_rate("caught", "flagged"), 6).alias("hit_rate"),
                    rnd(F.coalesce(dbl("mrr_covered"), F.lit(0.0)), 2).alias("mrr_covered"))


def outreach_grid(spark: SparkSession, acct: DataFrame, dmax: int = GRID_DORM_MAX,
                  rmax: int = GRID_RISK_MAX) -> DataFrame:
    """Every slider setting at once: dormancy 0..dmax days x risk 0..rmax %.
    An account is flagged at (d, r) iff dorm >= d and 100*r <= risk*10000, so it
    counts in every cell up to (min(dorm, dmax), min(floor(risk%), rmax)): histogram
    on that capped pair, then 2-D suffix sums."""
    x = clean(acct)
    risk_bp = F.round(F.col("risk") * F.lit(10000.0)).cast("long")
    h = x.select(F.least(F.col("dorm"), F.lit(dmax)).cast("int").alias("d"),
                 F.least(F.floor(risk_bp / 100), F.lit(rmax)).cast("int").alias("r"),
                 "churned", money("mrr").alias("mrr"))
    hist = h.groupBy("d", "r").agg(F.count(F.lit(1)).alias("hn"), F.sum("churned").alias("hc"),
                                   F.sum("mrr").alias("hm"))
    tot = x.agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("churners"))
    n, churners = tot.select("n").scalar(), tot.select("churners").scalar()
    grid = spark.range(0, dmax + 1).select(F.col("id").cast("int").alias("d"),
                                           F.explode(F.sequence(F.lit(0), F.lit(rmax))).alias("r"))
    g = grid.join(hist, ["d", "r"], "left").select(
        "d", "r", F.coalesce("hn", F.lit(0)).alias("hn"), F.coalesce("hc", F.lit(0)).alias("hc"),
        F.coalesce("hm", money(F.lit(0))).alias("hm"))
    w1 = Window.partitionBy("d").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("d", "r", *[F.sum(c).over(w1).alias(c) for c in ("hn", "hc", "hm")])
    w2 = Window.partitionBy("r").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("d", "r", *[F.sum(c).over(w2).alias(c) for c in ("hn", "hc", "hm")])
    return g.select(F.col("d").alias("dorm_min"), F.col("r").alias("risk_pct"),
                    F.col("hn").cast("bigint").alias("flagged"),
                    rnd(_rate("hn", n), 6).alias("share_flagged"),
                    F.col("hc").cast("bigint").alias("caught"),
                    rnd(_rate("hc", churners), 6).alias("capture"),
                    rnd(_rate("hc", "hn"), 6).alias("hit_rate"),
                    rnd(dbl("hm"), 2).alias("mrr_covered"))


def _kpi_aggs():
    return [F.count(F.lit(1)).alias("n"), F.sum("churned").cast("bigint").alias("churners"),
            F.sum(money("mrr")).alias("mrr_sum"),
            F.sum(F.when(F.col("churned") == 1, money("mrr")).otherwise(money(F.lit(0)))).alias("mrr_lost")]


def _kpi_out(a: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "n", "churners", rnd(_rate("churners", "n"), 6).alias("churn_rate"),
                    rnd("mrr_sum", 2).alias("mrr_sum"), rnd("mrr_lost", 2).alias("mrr_lost"),
                    rnd(_rate("mrr_lost", "mrr_sum"), 6).alias("lost_share"),
                    F.coalesce(F.col("median_mrr"), F.lit(0.0)).alias("median_mrr"))


def upper_median(df: DataFrame, col: str, part_cols=()) -> DataFrame:
    """The element at 0-based index floor(n/2) of the ascending order (JS median)."""
    return order_statistics(df, col, {"median_mrr": lambda n: F.floor(n / 2)}, part_cols) \
        .drop("n")


def account_kpis(acct: DataFrame) -> DataFrame:
    x = clean(acct)
    a = x.agg(*_kpi_aggs())
    med = upper_median(x, "mrr").select("median_mrr").scalar()
    return _kpi_out(a.withColumn("median_mrr", med), [])


CUBE_DIMS = ["plan", "region", "contract"]


MEDIAN_BUCKETS = 64         # a CASE of this many bounds still compiles to one small method


def cell_upper_medians(x: DataFrame, col: str, dims: list[str], buckets: int = MEDIAN_BUCKETS) -> DataFrame:
    """``gid, dims, median``: the value at index floor(n/2) of every cell of the cube over ``dims``, exact, by selection.

    1. Bounds that cut all values into about equal ordered buckets (one sketch, one row).
    2. Rows per (base cell, bucket); only these counts are rolled up to the grouping sets, and each cell finds the
       bucket its median lies in.
    3. Of the rows only those in a bucket some cell needs are counted by value and rolled up; each cell picks
       by rank inside its bucket (``prefix_sums`` cuts a bucket that is large again).
    The rows themselves are never repeated per grouping set."""
    from .joins import bounded_broadcast
    from .ranking import _bsearch, join_null_safe
    found = x.agg(F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    bounds = sorted(set(found))
    placed = x.where(F.col(col).isNotNull()).select(*dims, F.col(col).alias("_v"),
                                                    _bsearch(F.col(col), bounds, 0, len(bounds)).alias("_b"))
    cells = [[d for i, d in enumerate(dims) if not (m >> (len(dims) - 1 - i)) & 1] for m in range(1 << len(dims))]

    def rolled(h: DataFrame, inside: list[str]) -> DataFrame:
        sets = [[*c, *inside] for c in cells]
        # the grouping id counts the inside columns, which every set has, as low zero bits
        return h.groupingSets(sets, *dims, *inside).agg(
            F.shiftright(F.grouping_id(), len(inside)).cast("bigint").alias("gid"), F.sum("n").alias("n"))

    cell = ["gid", *dims]
    per = rolled(placed.groupBy(*dims, "_b").agg(F.count(F.lit(1)).alias("n")), ["_b"])
    whole, up_to = Window.partitionBy(*cell), Window.partitionBy(*cell).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.select(*cell, "_b", "n", F.floor(F.sum("n").over(whole) / 2).alias("_want"),
                        F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("_below"))
    picks = bounded_broadcast(ranked.where((F.col("_below") <= F.col("_want")) & (F.col("_want") < F.col("_below") + F.col("n")))
                              .select(*cell, "_b", (F.col("_want") - F.col("_below")).alias("_want")))
    needed = placed.join(picks.select("_b").distinct(), "_b", "left_semi").groupBy(*dims, "_b", "_v").agg(F.count(F.lit(1)).alias("n"))
    values = join_null_safe(rolled(needed, ["_b", "_v"]), picks, [*cell, "_b"])
    at = prefix_sums(values, "_v", ["n"], cell)
    return at.where((F.col("n_below") <= F.col("_want")) & (F.col("_want") < F.col("n_below") + F.col("n"))) \
        .select(*cell, F.col("_v").alias("median"))


def account_cube_all(acct: DataFrame) -> DataFrame:
    """KPI strip for every filter combination (A20).  Additive parts through
    grouping sets; the upper median is not additive and is selected by rank per cell."""
    from .ranking import join_null_safe
    x = clean(acct)
    sets = [[d for i, d in enumerate(CUBE_DIMS) if not (m >> (2 - i)) & 1] for m in range(8)]
    a = x.groupingSets(sets, *CUBE_DIMS).agg(F.grouping_id().cast("bigint").alias("gid"), *_kpi_aggs())
    med = cell_upper_medians(x, "mrr", CUBE_DIMS).withColumnRenamed("median", "median_mrr")
    j = join_null_safe(a, med, ["gid", *CUBE_DIMS], "left")
    return _kpi_out(j, ["gid", *CUBE_DIMS])


def outreach_cube(acct: DataFrame, dmax: int = GRID_DORM_MAX, rmax: int = GRID_RISK_MAX, dorm_step: int = 1,
                  risk_step: int = 1) -> DataFrame:
    """The simulator's grid (A12) under every filter combination of plan, region and contract (W2): thresholds
    0, step, 2 step ... on both axes.

    Accounts are counted once per (base cell, capped dormancy, capped risk); those sparse counts are rolled up to
    the grouping sets, filled up to a dense grid per cell, and summed over the larger thresholds along both
    axes (a summed-area table a cell).  Its size depends on cells and thresholds, not on accounts."""
    x = clean(acct)
    risk_bp = F.round(F.col("risk") * F.lit(10000.0)).cast("long")
    d = F.floor(F.least(F.col("dorm"), F.lit(dmax)) / dorm_step).cast("int").alias("d")
    r = F.floor(F.least(F.floor(risk_bp / 100), F.lit(rmax)) / risk_step).cast("int").alias("r")
    sums = ("hn", "hc", "hm")
    base = x.groupBy(*CUBE_DIMS, d, r).agg(F.count(F.lit(1)).alias("hn"), F.sum("churned").alias("hc"), F.sum(money("mrr")).alias("hm"))
    sets = [[c for i, c in enumerate(CUBE_DIMS) if not (m >> (2 - i)) & 1] + ["d", "r"] for m in range(8)]
    cell = ["gid", *CUBE_DIMS]
    sparse = base.groupingSets(sets, *CUBE_DIMS, "d", "r").agg(
        F.shiftright(F.grouping_id(), 2).cast("bigint").alias("gid"), *[F.sum(c).cast("decimal(38,2)").alias(c) for c in sums])
    axis = {"d": dmax // dorm_step, "r": rmax // risk_step}
    zeros = sparse.select(*cell).distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(axis["d"])))) \
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(axis["r"])))) \
        .select(*cell, "d", "r", *[F.lit(0).cast("decimal(38,2)").alias(c) for c in sums])
    g = sparse.select(*cell, "d", "r", *sums).unionByName(zeros).groupBy(*cell, "d", "r") \
        .agg(*[F.sum(c).cast("decimal(38,2)").alias(c) for c in sums])
    all_of = Window.partitionBy(*cell)
    g = g.select("*", F.sum("hn").over(all_of).alias("n"), F.sum("hc").over(all_of).alias("churners"))
    for fixed, along in (("d", "r"), ("r", "d")):
        w = Window.partitionBy(*cell, fixed).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)
        g = g.select(*cell, "d", "r", "n", "churners", *[F.sum(c).over(w).alias(c) for c in sums])
    return g.where((F.col("d") >= 0) & (F.col("r") >= 0)).select(
        *cell, (F.col("d") * dorm_step).alias("dorm_min"), (F.col("r") * risk_step).alias("risk_pct"),
        F.col("hn").cast("bigint").alias("flagged"), rnd(_rate("hn", "n"), 6).alias("share_flagged"),
        F.col("hc").cast("bigint").alias("caught"), rnd(_rate("hc", "churners"), 6).alias("capture"),
        rnd(_rate("hc", "hn"), 6).alias("hit_rate"), rnd(dbl("hm"), 2).alias("mrr_covered"))


def top_risk_accounts(acct: DataFrame, k: int = 12) -> DataFrame:
    """Top k by risk, ties by id (TakeOrderedAndProject: k rows per task, merged)."""
    return clean(acct).orderBy(F.desc("risk"), F.asc("id")).limit(k) \
        .select("id", "plan", "region", "mrr", "dorm", "risk", "churned")


def decile_capture(acct: DataFrame, frac: float = 0.10) -> DataFrame:
    """Top floor(n * frac) accounts by (risk desc, id): their MRR and the share of
    all churners they contain (K2, F8).  Exact without a global sort: counts per
    score value -> prefix sum (descending) -> whole groups above the cut, plus the
    first m ids of the one group that straddles it."""
    x = clean(acct)
    tot = x.agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("churners"))
    k = F.floor(tot.select("n").scalar().cast("decimal(20,0)") * F.lit(Decimal(str(frac)))).cast("bigint")
    g = x.groupBy("risk").agg(F.count(F.lit(1)).alias("gn"), F.sum("churned").alias("gc"),
                              F.sum(money("mrr")).alias("gm"))
    ps = prefix_sums(g, "risk", ["gn"], descending=True)
    full = ps.where(F.col("gn_below") + F.col("gn") <= k).agg(
        F.sum("gc").alias("c"), F.sum("gm").alias("m"), F.sum("gn").alias("cnt"))
    cut = ps.where((F.col("gn_below") < k) & (k < F.col("gn_below") + F.col("gn")))
    r_star = cut.agg(F.max("risk")).scalar()
    m = cut.agg(F.max(k - F.col("gn_below"))).scalar()
    at = x.where(F.col("risk") == r_star).select("id", "churned", money("mrr").alias("mrr"),
                                                  F.lit(1).alias("one"))
    part = prefix_sums(at, "id", ["one"]).where(F.col("one_below") < m).agg(
        F.sum("churned").alias("c"), F.sum("mrr").alias("m"), F.count(F.lit(1)).alias("cnt"))
    both = full.unionByName(part).agg(F.sum("c").alias("c"), F.sum("m").alias("m"),
                                      F.sum("cnt").alias("cnt"))
    return both.select(F.coalesce("cnt", F.lit(0)).cast("bigint").alias("top_n"),
                       rnd(F.coalesce(dbl("m"), F.lit(0.0)), 2).alias("mrr_at_risk"),
                       F.coalesce("c", F.lit(0)).cast("bigint").alias("churners_captured"),
                       rnd(_rate(F.coalesce("c", F.lit(0)), tot.select("churners").scalar()), 6)
                       .alias("capture"))


# ------------------------------------------------------------------ dictionaries

def dict_plan_by_median(acct: DataFrame) -> DataFrame:
    """Plans coded by median MRR ascending (linear interpolation), ties by name.
    The ordinal window runs over the distinct plan list (a dictionary, bounded)."""
    med = quantiles(clean(acct), "mrr", {"median": 0.5}, ["plan"])
    code = F.row_number().over(Window.orderBy("median", "plan")) - 1
    return med.select("plan", rnd("median", 4).alias("median_mrr"), code.alias("code"))


def dict_alpha(acct: DataFrame, col: str = "region") -> DataFrame:
    d = clean(acct).select(col).distinct()
    return d.select(F.col(col).alias("value"), (F.row_number().over(Window.orderBy(col)) - 1).alias("code"))


def dict_preferred(acct: DataFrame, col: str = "contract", preferred=PREFERRED_CONTRACTS) -> DataFrame:
    d = clean(acct).select(col).distinct()
    pos = F.nullif(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(col)), F.lit(0))
    code = F.row_number().over(Window.orderBy(F.asc_nulls_last(pos), F.col(col))) - 1
    return d.select(F.col(col).alias("value"), code.alias("code"))


def cube_sample(acct: DataFrame, percent: int) -> DataFrame:
    """A deterministic share of the rows for export (S11): those whose md5 bucket is below
    ``percent``; it grows with the input and needs no ranking."""
    return clean(acct).where(dup_bucket() < percent)


def account_cube(acct: DataFrame) -> DataFrame:
    """Compact cube of every account (P10): ordinal, dictionary codes, rounded measures.  The ordinal is an
    exact distributed rank over (id): equal ids are one step of the prefix sum and numbered inside it."""
    x = clean(acct)
    plans = dict_plan_by_median(acct).select("plan", F.col("code").alias("plan_code"))
    regions = dict_alpha(acct, "region").select(F.col("value").alias("region"),
                                                F.col("code").alias("region_code"))
    contracts = dict_preferred(acct).select(F.col("value").alias("contract"),
                                            F.col("code").alias("contract_code"))
    ids = x.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    start = prefix_sums(ids, "id", ["_n"]).select(F.col("id").alias("_id"), "_n_below")
    same = F.row_number().over(Window.partitionBy("id").orderBy("plan", "region", "contract", "mrr", "dorm", "risk", "churned"))
    j = x.withColumn("_same", same - 1).join(start, F.col("id") == F.col("_id")) \
        .join(plans, "plan").join(regions, "region").join(contracts, "contract")
    return j.select((F.col("_n_below") + F.col("_same")).cast("bigint").alias("ordinal"), "id",
                    "plan_code", "region_code", "contract_code", rnd("mrr", 2).alias("mrr"),
                    F.col("dorm").cast("bigint").alias("dorm"), "churned", rnd("risk", 4).alias("risk"))


def report_kpi_lines(acct: DataFrame) -> DataFrame:
    """Markdown-report KPI lines (S9, A14), formatted from the aggregated row only."""
    k = account_kpis(acct)

    def usd(c):
        return F.concat(F.lit("$"), F.format_number(js_round(c).cast("long"), 0))

    def pct(c):
        return F.format_string("%.1f%%", rnd(F.col(c) * 100, 1))

    lines = F.array(
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("Accounts: "), F.format_number(F.col("n"), 0)).alias("text")),
        F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("Churn rate: "), pct("churn_rate"),
                                                     F.lit(" ("), F.format_number(F.col("churners"), 0),
                                                     F.lit(" of "), F.format_number(F.col("n"), 0),
                                                     F.lit(" accounts)")).alias("text")),
        F.struct(F.lit(3).alias("line_no"), F.concat(F.lit("Monthly revenue: "), usd(F.col("mrr_sum"))).alias("text")),
        F.struct(F.lit(4).alias("line_no"), F.concat(F.lit("MRR lost to churn: "), usd(F.col("mrr_lost")),
                                                     F.lit(" ("), pct("lost_share"), F.lit(" of selected revenue)"))
                 .alias("text")),
        F.struct(F.lit(5).alias("line_no"), F.concat(F.lit("Median MRR: "), usd(F.col("median_mrr"))).alias("text")))
    return k.select(F.explode(lines).alias("l")).select("l.*")


def level_ratio(acct: DataFrame, level_a: str, level_b: str) -> DataFrame:
    """Ratio of the churn rates of two plan levels (E16), conditional aggregates."""
    x = clean(acct)
    a = x.agg(F.count_if(F.col("plan") == level_a).alias("na"),
              F.sum(F.when(F.col("plan") == level_a, F.col("churned")).otherwise(0)).alias("ca"),
              F.count_if(F.col("plan") == level_b).alias("nb"),
              F.sum(F.when(F.col("plan") == level_b, F.col("churned")).otherwise(0)).alias("cb"))
    ra, rb = F.try_divide(dbl("ca"), dbl("na")), F.try_divide(dbl("cb"), dbl("nb"))
    return a.select(F.lit(level_a).alias("level_a"), F.lit(level_b).alias("level_b"),
                    rnd(ra, 6).alias("rate_a"), rnd(rb, 6).alias("rate_b"),
                    rnd(F.try_divide(ra, rb), 6).alias("ratio"))


def scope_sentence(acct: DataFrame, plan=None, region=None, contract=None) -> DataFrame:
    """Filtered count as a sentence (A14): the levels chosen, "all" where none is."""
    counted = account_filter(acct, plan, region, contract).agg(F.count(F.lit(1)).alias("n"))
    chosen = {"plan": plan, "contract": contract, "region": region}
    scope = ", ".join(f"{name} {level}" for name, level in chosen.items() if level is not None) or "all accounts"
    return counted.select("n", F.concat_ws(" ", F.format_number("n", 0), F.lit("accounts:"), F.lit(scope)).alias("sentence"))


def dup_bucket(col: str = "id") -> F.Column:
    return F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10).cast("bigint") % 100


def union_all_dupes(acct: DataFrame, pct: int = 5) -> DataFrame:
    """Rows plus planted exact copies of a deterministic ``pct`` % subset (K7)."""
    x = clean(acct)
    return x.unionByName(x.where(dup_bucket() < pct))


def dedupe(acct: DataFrame, pct: int = 5) -> DataFrame:
    """Full-row de-duplication (K6) of the table with planted copies."""
    return union_all_dupes(acct, pct).dropDuplicates()
