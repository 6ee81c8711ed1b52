"""Subscription retention and unit economics over the ``sub`` view (family E),
plus the compact weekly/subscription cubes and their dictionaries.

Scale: KPIs are conditional sums in one aggregate (with a region rollup).  The
retention curve never explodes accounts: accounts collapse to a histogram over
(channel, signup week, capped tenure) -- bounded by the calendar -- and only that
histogram is expanded over t = 0..52.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import MONEY_SUMS
from ..functions.numeric import dbl, money, rnd
from ..plans.views import LAST_WEEK
from .joins import bounded_broadcast

HORIZON = 52                 # retention curve: t = 0..52 weeks
GROSS_MARGIN = Decimal("0.78")
WEEKS_PER_MONTH = Decimal("4.33")


def cohort_flag() -> F.Column:
    """Alive at week 0: signed up before the window and never churned or churned
    inside it (W7)."""
    return (F.col("signup") < 0) & (F.col("churn").isNull() | (F.col("churn") >= 0))


def nrr_cohort(sub: DataFrame) -> DataFrame:
    return sub.where(cohort_flag()).select("account_id", "region", "signup", "churn", "active",
                                           "prior", "mrr")


def _by_region(sub: DataFrame, *aggs) -> DataFrame:
    """Per region and for all regions (rollup); ``region`` NULL = all."""
    return sub.groupingSets([["region"], []], "region").agg(
        F.grouping_id().cast("bigint").alias("gid"), *aggs)


def retention_kpis(sub: DataFrame) -> DataFrame:
    """NRR, GRR and logo retention of the week-0 cohort (E1-E3), 0 on empty cohorts."""
    coh = cohort_flag()
    act = coh & (F.col("active") == 1)
    a = _by_region(
        sub,
        F.sum(F.when(coh, money("prior"))).alias("start_mrr"),
        F.sum(F.when(act, money("mrr"))).alias("end_mrr"),
        F.sum(F.when(act, F.least(money("mrr"), money("prior")))).alias("grr_mrr"),
        F.count_if(coh).alias("cohort"),
        F.count_if(act).alias("retained"))

    def r(num, den):
        return rnd(F.coalesce(F.try_divide(dbl(num), dbl(den)), F.lit(0.0)), 6)

    return a.select("gid", "region", "cohort", "retained", rnd(F.coalesce(dbl("start_mrr"), F.lit(0.0)), 2)
                    .alias("start_mrr"), r("end_mrr", "start_mrr").alias("nrr"),
                    r("grr_mrr", "start_mrr").alias("grr"), r("retained", "cohort").alias("logo"))


def unit_economics(sub: DataFrame) -> DataFrame:
    """ARR, ARPA, mean CAC over all rows, LTV from churned tenure, CAC payback and
    LTV:CAC (E4-E7).  Payback and LTV:CAC are NULL where the reference divides by 0."""
    a = _by_region(
        sub,
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(F.col("active") == 1).alias("active"),
        F.sum(F.when(F.col("active") == 1, money("mrr"))).alias("mrr"),
        F.sum(money("cac")).alias("cac_sum"),
        F.count_if(F.col("active") == 0).alias("churned"),
        F.sum(F.when(F.col("active") == 0, F.col("tenure"))).alias("tenure_sum"))
    arpa = F.coalesce(F.try_divide(dbl("mrr"), dbl("active")), F.lit(0.0))
    cac = F.coalesce(F.try_divide(dbl("cac_sum"), dbl("accounts")), F.lit(0.0))
    ten_m = F.coalesce(F.try_divide(F.try_divide(dbl("tenure_sum"), dbl("churned")),
                                    F.lit(float(WEEKS_PER_MONTH))), F.lit(0.0))
    ltv = arpa * F.lit(float(GROSS_MARGIN)) * ten_m
    x = a.select("gid", "region", "accounts", "active", "churned",
                 F.coalesce(dbl("mrr"), F.lit(0.0)).alias("mrr_d"), arpa.alias("arpa"),
                 cac.alias("cac"), ten_m.alias("tenure_months"), ltv.alias("ltv"))
    return x.select("gid", "region", "accounts", "active", "churned",
                    rnd(F.col("mrr_d") * 12, 2).alias("arr"), rnd("arpa", 6).alias("arpa"),
                    rnd("cac", 6).alias("cac"), rnd("tenure_months", 6).alias("tenure_months"),
                    rnd("ltv", 6).alias("ltv"),
                    rnd(F.try_divide(F.col("cac"), F.col("arpa") * F.lit(float(GROSS_MARGIN))), 6)
                    .alias("cac_payback_months"),
                    rnd(F.try_divide(F.col("ltv"), F.col("cac")), 6).alias("ltv_cac"))


def retention_curve(sub: DataFrame, horizon: int = HORIZON, last_week: int = LAST_WEEK) -> DataFrame:
    """Fixed-cohort survival per channel (E8): at t, accounts with N - signup >= t
    are at risk and those with tenure >= t retained; where nobody is at risk the
    previous value is carried forward (1 before any) (N7)."""
    h = sub.select("channel", "signup", F.least(F.col("tenure"), F.lit(horizon)).alias("u")) \
        .groupBy("channel", "signup", "u").agg(F.count(F.lit(1)).alias("k"))
    # each histogram cell is at risk for t = 0..min(horizon, N - signup)
    top = F.least(F.lit(horizon), F.lit(last_week) - F.col("signup"))
    e = h.where(top >= 0).select("channel", "u", "k", F.explode(F.sequence(F.lit(0), top.cast("int"))).alias("t"))
    c = e.groupBy("channel", "t").agg(F.sum("k").alias("at_risk"),
                                      F.sum(F.when(F.col("u") >= F.col("t"), F.col("k")).otherwise(0))
                                      .alias("retained"))
    grid = sub.select("channel").distinct().select(
        "channel", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("t"))
    g = grid.join(c, ["channel", "t"], "left")
    rate = F.try_divide(dbl("retained"), dbl("at_risk"))
    w = Window.partitionBy("channel").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("raw", rate)
    filled = F.coalesce(F.last("raw", ignorenulls=True).over(w), F.lit(1.0))
    return g.select("channel", F.col("t").cast("int").alias("t"),
                    F.coalesce("at_risk", F.lit(0)).cast("bigint").alias("at_risk"),
                    F.coalesce("retained", F.lit(0)).cast("bigint").alias("retained"),
                    rnd(filled, 6).alias("rate"))


def sub_region_semi(sub: DataFrame, wk: DataFrame) -> DataFrame:
    """Accounts whose region occurs in the marketplace fact (J3, left semi join).
    The build side is the fact's distinct region list, broadcast behind a row-count
    check, so the account side is not shuffled."""
    return sub.join(bounded_broadcast(wk.select("region").distinct()), "region", "left_semi")


# ------------------------------------------------------------------ dictionaries and compact cubes

def dict_by_sum(wk: DataFrame) -> DataFrame:
    """Categories and regions by GDV, channels by campaigns, descending; ties by
    value (P9).  The ordinal window runs over each (small) level list."""
    parts = []
    for dim, measure in (("category", "gdv"), ("region", "gdv"), ("channel", "camp")):
        a = wk.groupBy(dim).agg(F.sum(measure).alias("total"))
        parts.append(a.select(F.lit(dim).alias("dim"), F.col(dim).alias("value"),
                              dbl("total").alias("total")))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    code = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("total"), "value")) - 1
    return u.select("dim", "value", rnd("total", 4).alias("total"), code.alias("code"))


def _codes(d: DataFrame, dim: str, name: str) -> DataFrame:
    return d.where(F.col("dim") == dim).select(F.col("value").alias(name), F.col("code").alias(f"{name}_code"))


def weekly_cube(wk: DataFrame, weeks: DataFrame) -> DataFrame:
    """Compact weekly rows (P11): week index and dictionary codes, money to whole
    units (half-even), payout days to 2 dp, counts as integers."""
    d = dict_by_sum(wk)
    j = wk.join(F.broadcast(weeks.select("week", "week_idx")), "week") \
        .join(_codes(d, "category", "category"), "category") \
        .join(_codes(d, "region", "region"), "region") \
        .join(_codes(d, "channel", "channel"), "channel")
    fields = ["camp", "funded", "fast", "goal", "gdv", "don", "donors", "retdon", "fromdon", "repeatorg",
              "tips", "procrev", "proccost", "rev", "refunds", "refamt", "cb", "fraud"]
    cols = [F.col("week_idx").alias("w"), F.col("category_code").alias("cat"),
            F.col("region_code").alias("reg"), F.col("channel_code").alias("ch")]
    for f in fields:
        cols.append(F.bround(F.col(f), 0).cast("bigint").alias(f) if f in MONEY_SUMS
                    else F.col(f).cast("bigint").alias(f))
    cols += [(F.col("paydays_x100") / 100).alias("paydays"), F.col("paid"),
             F.col("spend").cast("bigint").alias("spend")]
    return j.select(*cols)


def decode_weekly_cube(cube: DataFrame, wk: DataFrame, weeks: DataFrame) -> DataFrame:
    """Codes back to labels (J2): the dashboard's lookup of a compact cube row's week,
    category, region and channel.  The week list is calendar-bounded (broadcast);
    the level dictionaries are left to AQE, which broadcasts them once measured."""
    d = dict_by_sum(wk)

    def labels(dim: str, code: str) -> DataFrame:
        return d.where(F.col("dim") == dim).select(F.col("code").alias(code), F.col("value").alias(dim))

    j = cube.join(F.broadcast(weeks.select(F.col("week_idx").alias("w"), "week")), "w") \
        .join(labels("category", "cat"), "cat") \
        .join(labels("region", "reg"), "reg") \
        .join(labels("channel", "ch"), "ch")
    return j.select("week", "category", "region", "channel", "camp", "gdv", "don", "spend")


def sub_cube(sub: DataFrame, wk: DataFrame) -> DataFrame:
    """Compact account rows (P12): tier/channel alphabetical codes, region coded as
    in the weekly cube, only regions present there (J3); NULL churn stays NULL."""
    d = dict_by_sum(wk)
    s = sub_region_semi(sub, wk)
    # three dictionaries, each materialized once and broadcast behind a row-count
    # check: the account rows are joined in place, never shuffled
    tiers = bounded_broadcast(s.select("tier").distinct().select(
        "tier", (F.row_number().over(Window.orderBy("tier")) - 1).alias("tier_code")))
    chans = bounded_broadcast(s.select("channel").distinct().select(
        "channel", (F.row_number().over(Window.orderBy("channel")) - 1).alias("channel_code")))
    regions = bounded_broadcast(_codes(d, "region", "region"))
    j = s.join(tiers, "tier").join(chans, "channel").join(regions, "region")
    return j.select("account_id", F.col("tier_code").alias("tier"), F.col("region_code").alias("reg"),
                    F.col("channel_code").alias("ch"), "signup", "churn", "active", "tenure",
                    rnd("prior", 2).alias("prior"), rnd("mrr", 2).alias("mrr"), rnd("cac", 2).alias("cac"))


SRC_NAMES = {
    # The reference's source column name for each weekly field.
    "camp": "campaigns_created", "funded": "campaigns_fully_funded",
    "fast": "campaigns_funded_24h", "goal": "goal_amount", "gdv": "gdv",
    "don": "donations", "donors": "donors", "retdon": "returning_donors",
    "fromdon": "organizers_from_donors", "repeatorg": "repeat_organizers",
    "tips": "tips_revenue", "procrev": "processing_revenue",
    "proccost": "processing_cost", "rev": "net_revenue",
    "refunds": "refunds", "refamt": "refund_amount", "cb": "chargebacks",
    "fraud": "fraud_flagged", "paydays": "payout_days",
    "paid": "is_paid_channel", "spend": "marketing_spend",
}


def wk_rename(wk: DataFrame) -> DataFrame:
    """Field -> source-name rename through a map (P3, U3); the contract check runs on
    the schema before any job."""
    from ..sources.files import require_columns
    x = wk.withColumn("paydays", F.col("paydays_x100") / 100).drop("paydays_x100")
    require_columns(x, SRC_NAMES.keys(), "weekly fact")
    x = x.select("week", "category", "region", "channel",
                 *[rnd(c, 4).alias(c) if c in MONEY_SUMS else F.col(c) for c in SRC_NAMES])
    return x.withColumnsRenamed(SRC_NAMES)
