"""Canonical analysis views over the driver tables (FIXTURES.md section 3).

``acct``  one row per customer: plan, region, contract, mrr, dormancy, churn, risk.
``wk``    weekly facts at week x category x region x channel (sparse), additive only.
``sub``   one row per ordering customer: subscription-style signup/churn/tenure/mrr.

Scale notes.  Every per-customer quantity is a ``groupBy`` with partial
aggregation, so a customer holding a third of all orders costs one extra row per
map task, not a hot reducer.  The only windows run over a customer's *distinct
order dates* and priorities (bounded by the calendar) or over the distinct week list (a few
hundred rows per decade).  Dimension tables ``nation`` (25 rows) and ``region``
(5 rows) are fixed-size by the TPC-H specification and broadcast explicitly;
every other join is left to AQE, which broadcasts a side only after measuring it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dbl, money, rnd
from ..operators.ranking import join_null_safe
from ..sources.tables import Tables

# Fixed parameters of the views (FIXTURES.md section 3).
HORIZON_DAYS = 182          # acct: future window; wk: repeat-organizer look-back
RISK_HALF_WEEKS = 34        # acct: risk = dorm / (dorm + 34)
LEAK_ZERO_PCT = 7           # acct: share of positives zeroed in the planted leak
FAST_DAYS = 90              # wk: "funded fast" = a line ships within 90 days
WINDOW_WEEKS = 27           # sub: last 27 present weeks, week 0 = first of them
CHURN_LAG_WEEKS = 13        # sub: churn = last order week + 13
LAST_WEEK = WINDOW_WEEKS - 1

# Assumed marketing cost per order by channel (market segment): a ladder of 15 a step.
CHANNEL_COST = {"AUTOMOBILE": 15, "BUILDING": 30, "FURNITURE": 45, "MACHINERY": 60, "HOUSEHOLD": 0}
# Assumed acquisition cost by subscription channel (first order priority): 200 a step of urgency.
SUB_CAC = {"1-URGENT": 1100, "2-HIGH": 900, "3-MEDIUM": 700, "4-NOT SPECIFIED": 300, "5-LOW": 500}
UNPAID_CHANNEL = "HOUSEHOLD"


def lookup(col: str | Column, table: dict, default=None) -> Column:
    """Literal map lookup as a CASE expression (stays in codegen, no join)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in table.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def customer_geo(t: Tables) -> DataFrame:
    """customer with its region name; nation/region are fixed 25/5-row tables."""
    geo = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("n_nationkey", "r_name")
    return t.customer.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("c_custkey", "c_mktsegment", "r_name")


def _orders(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        money("o_totalprice").alias("price"),
        F.to_date("o_orderdate").alias("od"),
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"))


# --------------------------------------------------------------------------- acct

def acct(t: Tables) -> DataFrame:
    o = _orders(t)
    t0 = o.agg(F.date_sub(F.max("od"), HORIZON_DAYS)).scalar()
    flagged = o.select("o_custkey", "price", "od", (F.col("od") <= t0).alias("past"))
    per = flagged.groupBy("o_custkey").agg(
        F.count_if("past").alias("n_past"),
        F.sum(F.when(F.col("past"), F.col("price"))).alias("s_past"),
        F.max(F.when(F.col("past"), F.col("od"))).alias("last_past"),
        F.count_if(~F.col("past")).alias("n_future"))
    base = customer_geo(t).join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    n_past = F.coalesce(F.col("n_past"), F.lit(0))
    dorm = F.floor(F.datediff(t0, F.col("last_past")) / F.lit(7))
    churned = F.when(F.coalesce(F.col("n_future"), F.lit(0)) == 0, 1).otherwise(0)
    bucket = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8), 16, 10) \
        .cast("bigint") % 100
    out = base.select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("plan"),
        F.col("r_name").alias("region"),
        F.when(n_past <= 6, "monthly").when(n_past <= 11, "annual").otherwise("multi-year")
        .alias("contract"),
        rnd(F.try_divide(dbl("s_past"), F.col("n_past")), 2).alias("mrr"),
        dorm.alias("dorm"),
        churned.cast("int").alias("churned"),
        bucket.alias("_bucket"))
    return out.select(
        "id", "plan", "region", "contract", "mrr", "dorm", "churned",
        rnd(F.col("dorm") / (F.col("dorm") + F.lit(float(RISK_HALF_WEEKS))), 4).alias("risk"),
        F.when((F.col("churned") == 1) & (F.col("_bucket") >= LEAK_ZERO_PCT), 1).otherwise(0)
        .cast("int").alias("leak_flag"))


# --------------------------------------------------------------------------- wk

WK_DIMS = ["week", "category", "region", "channel"]

def order_lines(t: Tables, o: DataFrame | None = None) -> DataFrame:
    """Line measures rolled up to one row per order.  lineitem INNER JOIN orders
    keeps both sides splittable by AQE (an order holding a third of all lines is
    cut into several tasks); the one-row-per-order result is then joined to
    orders.  Folding both into orders LEFT JOIN lineitem would save one shuffle of
    orders but make lineitem the outer join's unsplittable side."""
    o = o if o is not None else _orders(t)
    li = t.lineitem.select(
        "l_orderkey",
        money("l_extendedprice").alias("lp"),
        money("l_discount").alias("disc"),
        money("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").alias("is_r"),
        F.to_date("l_shipdate").alias("sd"))
    lo = li.join(o.select("o_orderkey", "od", "o_orderstatus"),
                 F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.abs(F.datediff(F.col("sd"), F.col("od")))
    return lo.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("lp").alias("l_gdv"),
        F.sum(F.col("lp") * F.col("disc")).alias("l_tips"),
        F.sum(F.col("lp") * F.col("tax")).alias("l_procrev"),
        F.sum(F.col("lp") * F.lit(Decimal("0.01"))).alias("l_proccost"),
        F.count_if("is_r").alias("l_refunds"),
        F.sum(F.when(F.col("is_r"), F.col("lp"))).alias("l_refamt"),
        F.count_if(F.col("is_r") & (F.col("o_orderstatus") == "F")).alias("l_cb"),
        F.sum(days).alias("l_days"),
        F.max(F.when(days <= FAST_DAYS, 1).otherwise(0)).alias("l_fast"))


def order_cells(t: Tables, o: DataFrame) -> DataFrame:
    """Order measures by week x category x region x channel.  Orders are summed per (customer, date, priority) before
    they move to their customer, and without their lines: a customer holding a third of all orders has a row a date and
    priority there, bounded by the calendar, and so have the windows."""
    cust = customer_geo(t)
    day = F.unix_date("od")
    per_date = (o.where(F.col("od").isNotNull()).groupBy("o_custkey", "od", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("camp"),
        F.count_if(F.col("o_orderstatus") == "F").alias("funded"),
        F.sum("price").alias("goal"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("week", F.to_date(F.date_trunc("week", "od"))))
    own = Window.partitionBy("o_custkey")
    # rows of one date share it: the range ends a day before
    before = own.orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    dated = per_date.select("*", F.max(day).over(before).alias("prev"), F.min("od").over(own).alias("first_od"))
    repeat = F.col("prev").isNotNull() & (day - F.col("prev") <= HORIZON_DAYS)
    # Two-step aggregation instead of count(distinct): first per (cell, customer), where the rows are, then per
    # cell, where distinct customers are plain counts (no Expand that multiplies the rows).
    per_cust = dated.groupBy(F.col("week"), F.col("o_orderpriority").alias("category"), F.col("r_name").alias("region"),
                             F.col("c_mktsegment").alias("channel"), "o_custkey").agg(
        F.sum("camp").alias("camp"),
        F.sum("funded").alias("funded"),
        F.sum("goal").alias("goal"),
        F.max(F.when(F.col("od") > F.col("first_od"), 1).otherwise(0)).alias("returning"),
        F.sum(F.when(repeat, F.col("camp")).otherwise(0)).alias("repeatorg"),
        F.sum("n_pending").alias("n_pending"))
    return per_cust.groupBy(*WK_DIMS).agg(
        F.sum("camp").alias("camp"),
        F.sum("funded").alias("funded"),
        F.sum("goal").alias("goal"),
        F.count(F.lit(1)).alias("donors"),
        F.sum("returning").alias("retdon"),
        F.sum(F.when(F.col("o_custkey") % 3 == 0, F.col("camp")).otherwise(0)).alias("fromdon"),
        F.sum("repeatorg").alias("repeatorg"),
        F.sum(F.when(F.col("o_custkey") % 7 == 0, F.col("n_pending")).otherwise(0)).alias("fraud"))


def line_cells(t: Tables, o: DataFrame) -> DataFrame:
    """Line measures by the same cells: the orders carry their cell and nothing else to their lines' sums, which
    are added up where they are made and never move on."""
    orders = (o.where(F.col("od").isNotNull()).join(customer_geo(t), F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "week", F.col("o_orderpriority").alias("category"), F.col("r_name").alias("region"),
                      F.col("c_mktsegment").alias("channel")))
    return (orders.join(order_lines(t, o), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(*WK_DIMS).agg(
        F.sum("l_fast").alias("fast"),
        F.sum("l_gdv").alias("gdv"),
        F.sum("n_lines").alias("don"),
        F.sum("l_tips").alias("tips"),
        F.sum("l_procrev").alias("procrev"),
        F.sum("l_proccost").alias("proccost"),
        F.sum("l_refunds").alias("refunds"),
        F.sum("l_refamt").alias("refamt"),
        F.sum("l_cb").alias("cb"),
        F.sum("l_days").alias("_days")))


def wk(t: Tables) -> DataFrame:
    o = _orders(t)
    z = F.lit(0)
    # both sides have a row a cell; a cell without lines has zero line measures
    x = join_null_safe(order_cells(t, o), line_cells(t, o), WK_DIMS, "left")
    g = x.select(
        *WK_DIMS, "camp", "funded", "goal", "donors", "retdon", "fromdon", "repeatorg", "fraud",
        *[F.coalesce(F.col(c), z.cast("bigint")).alias(c) for c in ("fast", "don", "refunds", "cb", "_days")],
        *[F.coalesce(F.col(c), money(z)).alias(c) for c in ("gdv", "tips", "procrev", "proccost", "refamt")])
    # mean |ship - order| days per line, kept as hundredths (integer, half up) so that
    # the campaign-weighted payout mean stays exact under any roll-up.
    pay = F.when(F.col("don") > 0,
                 F.expr("(200 * _days + don) div (2 * don)")).otherwise(F.lit(0).cast("bigint"))
    return g.select(
        *WK_DIMS, "camp", "funded", "fast", "goal", "gdv", "don", "donors", "retdon",
        "fromdon", "repeatorg", "tips", "procrev", "proccost",
        (F.col("tips") + F.col("procrev") - F.col("proccost")).alias("rev"),
        "refunds", "refamt", "cb", "fraud",
        pay.alias("paydays_x100"),
        F.when(F.col("channel") != UNPAID_CHANNEL, 1).otherwise(0).cast("int").alias("paid"),
        (F.col("camp") * lookup("channel", CHANNEL_COST, 0)).alias("spend"))


def week_index(t: Tables) -> DataFrame:
    """Present Monday weeks with their position (N1) and the subscription-window
    index (0 = first of the last 27 weeks).  The distinct-week list is bounded by
    the calendar (52 rows a year), so the global window runs on a tiny input."""
    weeks = _orders(t).select("week").distinct()
    w = Window.orderBy("week")
    everything = Window.partitionBy()
    return weeks.select(
        "week",
        (F.dense_rank().over(w) - 1).alias("week_idx"),
        (F.dense_rank().over(w) - 1 - (F.count(F.lit(1)).over(everything) - WINDOW_WEEKS))
        .cast("bigint").alias("sub_idx"))


# --------------------------------------------------------------------------- sub

def sub(t: Tables) -> DataFrame:
    # the present-week list is bounded by the calendar (<= 53 rows per year of data)
    o = _orders(t).join(F.broadcast(week_index(t).select("week", "sub_idx")), "week")
    before = F.col("sub_idx") < 0
    per = o.groupBy("o_custkey").agg(
        F.min(F.struct("od", "o_orderkey", "o_orderpriority")).alias("first"),
        F.min("sub_idx").alias("signup"),
        F.max("sub_idx").alias("last_idx"),
        F.count_if(before).alias("n_before"),
        F.sum(F.when(before, F.col("price"))).alias("s_before"),
        F.count_if(~before).alias("n_after"),
        F.sum(F.when(~before, F.col("price"))).alias("s_after"),
        F.count(F.lit(1)).alias("n_all"),
        F.sum("price").alias("s_all"))
    x = per.join(customer_geo(t), F.col("o_custkey") == F.col("c_custkey"))
    churn_at = F.col("last_idx") + CHURN_LAG_WEEKS
    prior = F.coalesce(F.try_divide(dbl("s_before"), F.col("n_before")),
                       F.try_divide(dbl("s_all"), F.col("n_all")))
    y = x.select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_mktsegment").alias("tier"),
        F.col("r_name").alias("region"),
        F.col("first.o_orderpriority").alias("channel"),
        F.col("signup"),
        F.when(churn_at <= LAST_WEEK, churn_at).alias("churn"),
        rnd(prior, 2).alias("prior"),
        rnd(F.coalesce(F.try_divide(dbl("s_after"), F.col("n_after")), prior), 2).alias("mrr"))
    return y.select(
        "account_id", "tier", "region", "channel", "signup", "churn",
        F.when(F.col("churn").isNull(), 1).otherwise(0).cast("int").alias("active"),
        F.greatest(F.coalesce("churn", F.lit(LAST_WEEK)) - F.col("signup"), F.lit(0))
        .cast("bigint").alias("tenure"),
        "prior", "mrr",
        lookup("channel", SUB_CAC, None).cast("double").alias("cac"))
