"""The canonical views written once more, independently, in DuckDB SQL.

The oracle queries in ``oracle.py`` prefix these CTEs; they mirror
``views.py`` definition by definition but share no code with it.
"""

from __future__ import annotations

# The parameters of the views, stated here once more so that a slip in views.py shows.
HORIZON_DAYS, RISK_HALF_WEEKS, LEAK_ZERO_PCT, FAST_DAYS = 182, 34, 7, 90
WINDOW_WEEKS, CHURN_LAG_WEEKS, LAST_WEEK = 27, 13, 26
UNPAID_CHANNEL = "HOUSEHOLD"
CHANNEL_COST = {"AUTOMOBILE": 15, "BUILDING": 30, "FURNITURE": 45, "MACHINERY": 60}
SUB_CAC = {"1-URGENT": 1100, "2-HIGH": 900, "3-MEDIUM": 700, "4-NOT SPECIFIED": 300, "5-LOW": 500}


def _case(col: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {arms} ELSE {default} END"


GEO = """geo AS (
  SELECT c.c_custkey, c.c_mktsegment, r.r_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

ORD = """ord AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         CAST(o_orderdate AS DATE) AS od,
         CAST(date_trunc('week', o_orderdate) AS DATE) AS week
  FROM orders)"""

ACCT = f"""acct AS (
  WITH t0 AS (SELECT max(od) - {HORIZON_DAYS} AS t0 FROM ord),
  per AS (
    SELECT o_custkey,
           count(*) FILTER (WHERE od <= t0) AS n_past,
           sum(price) FILTER (WHERE od <= t0) AS s_past,
           max(od) FILTER (WHERE od <= t0) AS last_past,
           count(*) FILTER (WHERE od > t0) AS n_future
    FROM ord, t0 GROUP BY o_custkey),
  b AS (
    SELECT g.c_custkey AS id, g.c_mktsegment AS plan, g.r_name AS region,
           CASE WHEN coalesce(n_past, 0) <= 6 THEN 'monthly'
                WHEN n_past <= 11 THEN 'annual' ELSE 'multi-year' END AS contract,
           round_even(CAST(s_past AS DOUBLE) / nullif(n_past, 0) * 100.0, 0) / 100.0 AS mrr,
           CAST(date_diff('day', last_past, t0) // 7 AS BIGINT) AS dorm,
           CAST(CASE WHEN coalesce(n_future, 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS churned,
           ('0x' || substr(md5(CAST(g.c_custkey AS VARCHAR)), 1, 8))::BIGINT % 100 AS bucket
    FROM geo g LEFT JOIN per ON per.o_custkey = g.c_custkey CROSS JOIN t0)
  SELECT id, plan, region, contract, mrr, dorm, churned,
         round_even(CAST(dorm AS DOUBLE) / (dorm + {float(RISK_HALF_WEEKS)}) * 10000.0, 0) / 10000.0 AS risk,
         CAST(CASE WHEN churned = 1 AND bucket >= {LEAK_ZERO_PCT} THEN 1 ELSE 0 END AS INTEGER) AS leak_flag
  FROM b)"""

WK = f"""wk AS (
  WITH lines AS (
    SELECT l.l_orderkey,
           count(*) AS n_lines,
           sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS l_gdv,
           sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS l_tips,
           sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))) AS l_procrev,
           sum(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.01) AS l_proccost,
           count(*) FILTER (WHERE l_returnflag = 'R') AS l_refunds,
           sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS l_refamt,
           count(*) FILTER (WHERE l_returnflag = 'R' AND o.o_orderstatus = 'F') AS l_cb,
           sum(abs(date_diff('day', o.od, CAST(l_shipdate AS DATE)))) AS l_days,
           max(CASE WHEN abs(date_diff('day', o.od, CAST(l_shipdate AS DATE))) <= {FAST_DAYS}
               THEN 1 ELSE 0 END) AS l_fast
    FROM lineitem l JOIN ord o ON l.l_orderkey = o.o_orderkey
    GROUP BY l.l_orderkey),
  cd AS (
    SELECT o_custkey, od,
           lag(od) OVER (PARTITION BY o_custkey ORDER BY od) AS prev_od,
           min(od) OVER (PARTITION BY o_custkey) AS first_od
    FROM (SELECT DISTINCT o_custkey, od FROM ord)),
  x AS (
    SELECT o.*, ln.*, g.r_name, g.c_mktsegment, cd.prev_od, cd.first_od
    FROM ord o LEFT JOIN lines ln ON o.o_orderkey = ln.l_orderkey
    JOIN geo g ON o.o_custkey = g.c_custkey
    JOIN cd ON cd.o_custkey = o.o_custkey AND cd.od = o.od),
  g AS (
    SELECT week, o_orderpriority AS category, r_name AS region, c_mktsegment AS channel,
           count(*) AS camp,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS funded,
           CAST(sum(coalesce(l_fast, 0)) AS BIGINT) AS fast,
           sum(price) AS goal,
           coalesce(sum(l_gdv), 0) AS gdv,
           CAST(sum(coalesce(n_lines, 0)) AS BIGINT) AS don,
           count(DISTINCT o_custkey) AS donors,
           count(DISTINCT CASE WHEN od > first_od THEN o_custkey END) AS retdon,
           count(*) FILTER (WHERE o_custkey % 3 = 0) AS fromdon,
           count(*) FILTER (WHERE prev_od IS NOT NULL AND date_diff('day', prev_od, od) <= {HORIZON_DAYS}) AS repeatorg,
           coalesce(sum(l_tips), 0) AS tips,
           coalesce(sum(l_procrev), 0) AS procrev,
           coalesce(sum(l_proccost), 0) AS proccost,
           CAST(sum(coalesce(l_refunds, 0)) AS BIGINT) AS refunds,
           coalesce(sum(l_refamt), 0) AS refamt,
           CAST(sum(coalesce(l_cb, 0)) AS BIGINT) AS cb,
           count(*) FILTER (WHERE o_orderstatus = 'P' AND o_custkey % 7 = 0) AS fraud,
           CAST(sum(coalesce(l_days, 0)) AS BIGINT) AS days
    FROM x GROUP BY ALL)
  SELECT week, category, region, channel, camp, funded, fast, goal, gdv, don, donors, retdon,
         fromdon, repeatorg, tips, procrev, proccost, tips + procrev - proccost AS rev,
         refunds, refamt, cb, fraud,
         CAST(CASE WHEN don > 0 THEN (200 * days + don) // (2 * don) ELSE 0 END AS BIGINT) AS paydays_x100,
         CAST(CASE WHEN channel <> '{UNPAID_CHANNEL}' THEN 1 ELSE 0 END AS INTEGER) AS paid,
         CAST(camp * {_case('channel', CHANNEL_COST, '0')} AS BIGINT) AS spend
  FROM g)"""

WEEKS = f"""weeks AS (
  SELECT week,
         CAST(dense_rank() OVER (ORDER BY week) - 1 AS BIGINT) AS week_idx,
         CAST(dense_rank() OVER (ORDER BY week) - 1 - (count(*) OVER () - {WINDOW_WEEKS}) AS BIGINT) AS sub_idx
  FROM (SELECT DISTINCT week FROM ord))"""

SUB = f"""sub AS (
  WITH o AS (SELECT ord.*, weeks.sub_idx FROM ord JOIN weeks USING (week)),
  per AS (
    SELECT o_custkey,
           arg_min(o_orderpriority, (od, o_orderkey)) AS channel,
           min(sub_idx) AS signup, max(sub_idx) AS last_idx,
           count(*) FILTER (WHERE sub_idx < 0) AS n_before,
           sum(price) FILTER (WHERE sub_idx < 0) AS s_before,
           count(*) FILTER (WHERE sub_idx >= 0) AS n_after,
           sum(price) FILTER (WHERE sub_idx >= 0) AS s_after,
           count(*) AS n_all, sum(price) AS s_all
    FROM o GROUP BY o_custkey),
  y AS (
    SELECT g.c_custkey AS account_id, g.c_mktsegment AS tier, g.r_name AS region, per.channel,
           signup,
           CASE WHEN last_idx + {CHURN_LAG_WEEKS} <= {LAST_WEEK} THEN last_idx + {CHURN_LAG_WEEKS} END AS churn,
           coalesce(CAST(s_before AS DOUBLE) / nullif(n_before, 0),
                    CAST(s_all AS DOUBLE) / nullif(n_all, 0)) AS prior,
           CAST(s_after AS DOUBLE) / nullif(n_after, 0) AS mrr_after
    FROM per JOIN geo g ON per.o_custkey = g.c_custkey)
  SELECT account_id, tier, region, channel, signup, churn,
         CAST(CASE WHEN churn IS NULL THEN 1 ELSE 0 END AS INTEGER) AS active,
         CAST(greatest(coalesce(churn, {LAST_WEEK}) - signup, 0) AS BIGINT) AS tenure,
         round_even(prior * 100.0, 0) / 100.0 AS prior, round_even(coalesce(mrr_after, prior) * 100.0, 0) / 100.0 AS mrr,
         CAST({_case('channel', SUB_CAC)} AS DOUBLE) AS cac
  FROM y)"""

_DEPS = {
    "geo": [], "ord": [], "weeks": ["ord"],
    "acct": ["geo", "ord"], "wk": ["geo", "ord"], "sub": ["geo", "ord", "weeks"],
}
_TEXT = {"geo": GEO, "ord": ORD, "weeks": WEEKS, "acct": ACCT, "wk": WK, "sub": SUB}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the requested views and what they depend on."""
    order: list[str] = []

    def add(n):
        for d in _DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(_TEXT[n] for n in order) + "\n"
