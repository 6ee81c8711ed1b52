"""DuckDB oracle SQL, one statement per registered query.

Each statement restates the query in plain SQL over the driver tables (through the
CTE views of ``oracle_views``).  Column names equal the Spark output's.
"""

from __future__ import annotations

from .oracle_metrics import (CATEGORY_RATES, CONDITIONAL, KPI_DELTAS, MONEY_SUMS, RATIOS, SUMS, TREND,
                             lower_is_better, measure_sql, metric_sql, ratio_sql, rnd_sql)
from .oracle_views import with_views

ALL_MEASURES = SUMS + list(CONDITIONAL)


def proj(keys, measures=(), ratios=()) -> str:
    cols = list(keys)
    for m in measures:
        cols.append(f"{rnd_sql(m, 4)} AS {m}" if m in MONEY_SUMS else f"CAST({m} AS BIGINT) AS {m}")
    for r in ratios:
        cols.append(f"{rnd_sql(ratio_sql(r), 6)} AS {r}")
    return ", ".join(cols)


def agg(by: str, src: str = "wk", where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    g = f" GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"SELECT {sel}{measure_sql()} FROM {src}{w}{g}"


def dense(dim: str, with_all: bool = False) -> str:
    """CTEs a (aggregate by week, dim) and filled (dense week x level grid); with
    ``with_all`` the all-levels rows (dim NULL) join the grid as one more level."""
    fill = ", ".join(f"coalesce(a.{m}, 0) AS {m}" for m in ALL_MEASURES)
    by = f"GROUPING SETS ((week, {dim}), (week))" if with_all else f"week, {dim}"
    eq = f"a.{dim} IS NOT DISTINCT FROM grid.{dim}" if with_all else f"a.{dim} = grid.{dim}"
    return (f", a AS (SELECT week, {dim}, {measure_sql()} FROM wk GROUP BY {by}),\n"
            f"grid AS (SELECT w.week, w.week_idx, l.{dim} FROM weeks w "
            f"CROSS JOIN (SELECT DISTINCT {dim} FROM a) l),\n"
            f"filled AS (SELECT grid.week, grid.week_idx, grid.{dim}, {fill} "
            f"FROM grid LEFT JOIN a ON a.week = grid.week AND {eq})\n")


LAST = "(SELECT week FROM weeks WHERE week_idx = (SELECT max(week_idx) FROM weeks))"


def weekly_sql(params: dict) -> dict[str, str]:
    V = with_views("wk", "weeks")
    q: dict[str, str] = {}
    q["weekly_measures"] = V + f"SELECT {proj(['week'], ALL_MEASURES)} FROM ({agg('week')})"
    q["weekly_ratios"] = V + f"SELECT {proj(['week'], [], list(RATIOS))} FROM ({agg('week')})"
    q["paid_cac"] = V + (f"SELECT {proj(['week'], ['camp', 'paid_camp', 'paid_spend', 'spend'], ['paidShare', 'paidCac'])} "
                         f"FROM ({agg('week')})")
    f = params["weekly_filter"]
    conds = [f"week = {LAST}"] + [f"{k} = '{v}'" for k, v in f.items() if v is not None]
    q["weekly_filter"] = V + f"SELECT {proj([], ALL_MEASURES, list(RATIOS))} FROM ({agg('', where=' AND '.join(conds))})"
    q["week_endpoints"] = V + (
        ", x AS (SELECT wk.*, CASE WHEN week_idx = (SELECT max(week_idx) FROM weeks) THEN 'last' "
        "WHEN week_idx = (SELECT max(week_idx) FROM weeks) - 1 THEN 'prev' WHEN week_idx = 0 THEN 'first' END AS endpoint "
        "FROM wk JOIN weeks USING (week))\n"
        f"SELECT {proj(['endpoint'], ['camp', 'gdv', 'rev', 'tips', 'don'], ['takeRate', 'tipRate'])} "
        f"FROM ({agg('endpoint', src='x', where='endpoint IS NOT NULL')})")
    fe = params["fraud_early_late"]
    cat, split = fe["category"], fe["split_idx"]

    def rate(cond):
        return (f"coalesce(CAST(sum(CASE WHEN {cond} THEN fraud ELSE 0 END) AS DOUBLE) / "
                f"nullif(CAST(sum(CASE WHEN {cond} THEN camp ELSE 0 END) AS DOUBLE), 0), 0)")

    q["fraud_early_late"] = V + (
        f"SELECT {rnd_sql(rate(f'category = {chr(39)}{cat}{chr(39)} AND week_idx < {split}'), 6)} AS fraud_early, "
        f"{rnd_sql(rate(f'category = {chr(39)}{cat}{chr(39)} AND week_idx >= {split}'), 6)} AS fraud_late, "
        f"{rnd_sql(rate(f'category <> {chr(39)}{cat}{chr(39)}'), 6)} AS fraud_base "
        f"FROM wk JOIN weeks USING (week)")

    # wow_delta on the dense region grid, long by metric
    vals = ", ".join(f"{metric_sql(m)} AS {m}" for m in KPI_DELTAS)
    unions = " UNION ALL ".join(
        f"SELECT week, week_idx, region, '{m}' AS metric, {m} AS value, "
        f"{'true' if lower_is_better(m) else 'false'} AS invert FROM v" for m in KPI_DELTAS)
    q["wow_delta"] = V + dense("region", with_all=True) + (
        f", v AS (SELECT week, week_idx, region, {vals} FROM filled),\n"
        f"l AS ({unions}),\n"
        "x AS (SELECT *, lag(value) OVER (PARTITION BY region, metric ORDER BY week_idx) AS prev FROM l),\n"
        "y AS (SELECT *, CASE WHEN prev <> 0 THEN (value - prev) / prev END AS delta FROM x)\n"
        f"SELECT week, region, metric, {rnd_sql('value', 6)} AS value, {rnd_sql('prev', 6)} AS prev, "
        f"{rnd_sql('delta', 6)} AS delta, "
        "CASE WHEN delta IS NULL THEN NULL WHEN abs(delta) < 0.005 THEN 'flat' "
        "WHEN invert <> (delta > 0) THEN 'up' ELSE 'down' END AS direction FROM y")
    q["wow_by_segment"] = V + dense("category") + (
        ", x AS (SELECT week, category, camp, CAST(gdv AS DOUBLE) AS gdv, "
        "lag(CAST(gdv AS DOUBLE)) OVER (PARTITION BY category ORDER BY week_idx) AS prev_gdv, "
        "lag(camp) OVER (PARTITION BY category ORDER BY week_idx) AS prev_camp FROM filled)\n"
        f"SELECT week, category, CAST(camp AS BIGINT) AS camp, CAST(prev_camp AS BIGINT) AS prev_camp, "
        f"{rnd_sql('gdv', 4)} AS gdv, {rnd_sql('prev_gdv', 4)} AS prev_gdv, "
        f"{rnd_sql('CASE WHEN prev_gdv <> 0 THEN (gdv - prev_gdv) / prev_gdv END', 6)} AS wow_gdv "
        "FROM x WHERE camp > 0")
    q["weekly_dense_trend"] = V + dense("region") + (
        f"SELECT {proj(['week', 'region'], ['camp', 'gdv', 'rev', 'don'], ['takeRate'])} FROM filled")
    avgs = ", ".join(
        f"{rnd_sql(f'avg(CAST({m} AS DOUBLE)) OVER (PARTITION BY region ORDER BY week_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)', 4)} AS {m}_4wk"
        for m in ("gdv", "rev", "camp", "don"))
    q["trailing_4wk"] = V + dense("region", with_all=True) + f"SELECT week, region, {avgs} FROM filled"
    q["trend"] = V + (f"SELECT week, " + ", ".join(f"{rnd_sql(metric_sql(m), 6)} AS {m}" for m in TREND)
                      + f" FROM ({agg('week')})")
    q["take_rate_split"] = V + f"SELECT {proj(['week'], [], ['tipRate', 'procRate', 'takeRate'])} FROM ({agg('week')})"
    q["trust_by_category"] = V + (f"SELECT {proj(['week', 'category'], ['camp'], ['refundRate', 'fraudRate'])} "
                                  f"FROM ({agg('week, category')}) WHERE camp > 0")
    q["channel_cac"] = V + (
        f"SELECT week, channel, CAST(camp AS BIGINT) AS camp, CAST(spend AS BIGINT) AS spend, "
        f"{rnd_sql('coalesce(CAST(spend AS DOUBLE) / nullif(CAST(camp AS DOUBLE), 0), 0)', 6)} AS cost_per_campaign "
        f"FROM ({agg('week, channel')})")
    seg_rates = ", ".join(f"{rnd_sql(ratio_sql(r), 6)} AS {r}" for r in
                          ("takeRate", "avgDonation", "fundedRate", "repeatDonor", "refundRate"))
    q["segment_table"] = V + dense("category") + (
        ", x AS (SELECT *, lag(CAST(gdv AS DOUBLE)) OVER (PARTITION BY category ORDER BY week_idx) AS prev_gdv FROM filled)\n"
        "SELECT week, category, "
        "CAST(row_number() OVER (PARTITION BY week ORDER BY gdv DESC, category) AS INTEGER) AS seg_rank, "
        f"{rnd_sql('gdv', 4)} AS gdv, "
        f"{rnd_sql('CAST(gdv AS DOUBLE) / sum(CAST(gdv AS DOUBLE)) OVER (PARTITION BY week)', 6)} AS share, "
        f"{seg_rates}, ({ratio_sql('refundRate')}) > {params['segment_table']['warn_refund']} AS refund_warn, "
        f"{rnd_sql('CASE WHEN prev_gdv <> 0 THEN (CAST(gdv AS DOUBLE) - prev_gdv) / prev_gdv END', 6)} AS wow_gdv "
        "FROM x WHERE camp > 0")
    # movers
    parts = []
    ctes = []
    for i, spec in enumerate(params["movers"]["watch"]):
        ctes.append(dense(spec.dim).replace(", a AS (", f", a{i} AS (").replace("FROM a)", f"FROM a{i})")
                    .replace("LEFT JOIN a ON a.", f"LEFT JOIN a{i} a ON a.")
                    .replace("grid AS", f"grid{i} AS").replace("FROM grid ", f"FROM grid{i} grid ")
                    .replace("filled AS", f"filled{i} AS"))
        parts.append(
            f"SELECT week, segment, '{spec.dim}' AS dim, '{spec.label}' AS metric, now, "
            f"(now - before) / before AS d, {'true' if lower_is_better(spec.metric) else 'false'} AS invert FROM ("
            f"SELECT *, lag(now) OVER (PARTITION BY segment ORDER BY week_idx) AS before, "
            f"lag(g) OVER (PARTITION BY segment ORDER BY week_idx) AS g_prev FROM ("
            f"SELECT week, week_idx, {spec.dim} AS segment, {metric_sql(spec.metric)} AS now, "
            f"CAST({spec.guard_measure} AS DOUBLE) AS g FROM filled{i})) "
            f"WHERE week_idx > 0 AND before <> 0 AND g >= {spec.guard_min} AND g_prev >= {spec.guard_min}")
    top = params["movers"]["top"]
    q["movers"] = V + "".join(ctes) + (
        f", allm AS ({' UNION ALL '.join(parts)}),\n"
        "r AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY abs(d) DESC, segment, metric) AS mover_rank FROM allm)\n"
        f"SELECT week, CAST(mover_rank AS INTEGER) AS mover_rank, segment, dim, metric, {rnd_sql('now', 6)} AS now, "
        f"{rnd_sql('d', 6)} AS change, CASE WHEN (invert AND d > 0) OR (NOT invert AND d < 0) THEN 'bad' ELSE 'good' END AS tone "
        f"FROM r WHERE mover_rank <= {top}")
    mx = "(SELECT max(week_idx) FROM weeks)"
    q["first_last_growth"] = V + (
        ", a AS (SELECT "
        f"sum(CASE WHEN week_idx = {mx} THEN gdv END) AS gdv, sum(CASE WHEN week_idx = {mx} THEN rev END) AS rev, "
        f"sum(CASE WHEN week_idx = {mx} THEN tips END) AS tips, sum(CASE WHEN week_idx = 0 THEN gdv END) AS gdv0, "
        "sum(CASE WHEN week_idx = 0 THEN rev END) AS rev0, sum(CASE WHEN week_idx = 0 THEN tips END) AS tips0 "
        f"FROM wk JOIN weeks USING (week) WHERE week_idx = 0 OR week_idx = {mx}),\n"
        "b AS (SELECT *, CAST(rev AS DOUBLE) / nullif(CAST(gdv AS DOUBLE), 0) AS take_now, "
        "CAST(rev0 AS DOUBLE) / nullif(CAST(gdv0 AS DOUBLE), 0) AS take_then, "
        "CAST(tips AS DOUBLE) / nullif(CAST(gdv AS DOUBLE), 0) AS tip_now, "
        "CAST(tips0 AS DOUBLE) / nullif(CAST(gdv0 AS DOUBLE), 0) AS tip_then FROM a)\n"
        f"SELECT {rnd_sql('gdv', 4)} AS gdv, {rnd_sql('rev', 4)} AS rev, {rnd_sql('take_now', 6)} AS take_now, "
        f"{rnd_sql('take_then', 6)} AS take_then, {rnd_sql('tip_now', 6)} AS tip_now, {rnd_sql('tip_then', 6)} AS tip_then, "
        f"{rnd_sql('CAST(gdv AS DOUBLE) / nullif(CAST(gdv0 AS DOUBLE), 0) - 1', 6)} AS gdv_growth, "
        f"{rnd_sql('CAST(rev AS DOUBLE) / nullif(CAST(rev0 AS DOUBLE), 0) - 1', 6)} AS rev_growth, "
        f"{rnd_sql('CAST(gdv AS DOUBLE) * (tip_then - tip_now)', 4)} AS forgone FROM b")
    q["category_profile"] = V + (
        "SELECT category, " + ", ".join(f"{rnd_sql(ratio_sql(r), 6)} AS {k}" for k, r in CATEGORY_RATES.items())
        + f", {rnd_sql('gdv', 4)} AS gdv FROM ({agg('category')})")
    q["fast_attain_corr"] = V + (
        f"SELECT {rnd_sql('corr(f, a)', 6)} AS fast_attain_corr, count(*) AS n_categories FROM ("
        f"SELECT {ratio_sql('fastRate')} AS f, {ratio_sql('attainment')} AS a FROM ({agg('category')}))")
    q["liquidity_latest"] = V + (
        f"SELECT {proj([], ['camp', 'gdv'], ['fundedRate', 'attainment', 'fastRate', 'avgDonation'])} "
        f"FROM ({agg('', where=f'week = {LAST}')})")
    q["paid_vs_blended_cac"] = V + (
        f"SELECT {rnd_sql(ratio_sql('viralShare'), 6)} AS viral, {rnd_sql(ratio_sql('paidShare'), 6)} AS paid_share, "
        f"{rnd_sql(ratio_sql('paidCac'), 6)} AS paid_cac, "
        f"{rnd_sql('coalesce(CAST(spend AS DOUBLE) / nullif(CAST(camp AS DOUBLE), 0), 0)', 6)} AS blended_cac "
        f"FROM ({agg('', where=f'week = {LAST}')})")
    q["weekly_cube_all"] = V + (
        f"SELECT {proj(['week', 'category', 'region', 'channel', 'gid'], SUMS, list(RATIOS))} FROM ("
        f"SELECT week, category, region, channel, CAST(grouping(category, region, channel) AS BIGINT) AS gid, {measure_sql()} "
        "FROM wk GROUP BY GROUPING SETS ((week, category, region, channel), (week, category, region), (week, category, channel), "
        "(week, category), (week, region, channel), (week, region), (week, channel), (week)))")
    by_cell = ("PARTITION BY gid, category, region, channel ORDER BY week_idx")
    fill = ", ".join(f"coalesce(a.{m}, 0) AS {m}" for m in ALL_MEASURES)
    cube = V + (
        f", a AS (SELECT week, category, region, channel, CAST(grouping(category, region, channel) AS BIGINT) AS gid, {measure_sql()} "
        "FROM wk GROUP BY GROUPING SETS ((week, category, region, channel), (week, category, region), (week, category, channel), "
        "(week, category), (week, region, channel), (week, region), (week, channel), (week))),\n"
        "cell AS (SELECT DISTINCT gid, category, region, channel FROM a),\n"
        f"filled AS (SELECT w.week, w.week_idx, c.gid, c.category, c.region, c.channel, {fill} FROM weeks w CROSS JOIN cell c "
        "LEFT JOIN a ON a.week = w.week AND a.gid = c.gid AND a.category IS NOT DISTINCT FROM c.category "
        "AND a.region IS NOT DISTINCT FROM c.region AND a.channel IS NOT DISTINCT FROM c.channel)\n")
    now = ", ".join(f"{metric_sql(m)} AS {m}" for m in KPI_DELTAS)
    prev = ", ".join(f"lag({m}) OVER ({by_cell}) AS p_{m}" for m in KPI_DELTAS)
    change = ", ".join(f"{rnd_sql(f'CASE WHEN p_{m} <> 0 THEN ({m} - p_{m}) / p_{m} END', 6)} AS wow_{m}" for m in KPI_DELTAS)
    q["wow_cube"] = cube + (
        f"SELECT week, gid, category, region, channel, {change} FROM (SELECT *, {prev} FROM ("
        f"SELECT week, week_idx, gid, category, region, channel, {now} FROM filled))")
    q["trailing_cube"] = cube + "SELECT week, gid, category, region, channel, " + ", ".join(
        f"{rnd_sql(f'avg(CAST({m} AS DOUBLE)) OVER ({by_cell} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)', 4)} AS {m}_4wk"
        for m in ("gdv", "rev", "camp", "don")) + " FROM filled"
    q["week_index"] = with_views("weeks") + "SELECT week, CAST(week_idx AS INTEGER) AS week_idx FROM weeks"
    return q


def accounts_sql(params: dict) -> dict[str, str]:
    DORM_BINS = [(0, 7, "0-7"), (8, 14, "8-14"), (15, 30, "15-30"), (31, 60, "31-60"), (61, 2**31 - 1, "60+")]
    PREFERRED_CONTRACTS = ["monthly", "quarterly", "annual", "multi-year"]
    V = with_views("acct") + (", c AS (SELECT id, plan, region, contract, mrr, dorm, churned, risk FROM acct "
                              "WHERE id IS NOT NULL AND plan IS NOT NULL AND region IS NOT NULL AND contract IS NOT NULL "
                              "AND mrr IS NOT NULL AND dorm IS NOT NULL AND churned IS NOT NULL AND risk IS NOT NULL)\n")
    rate = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"
    q: dict[str, str] = {}
    q["contract_dropna"] = V + "SELECT * FROM c"
    f = params["account_filter"]
    conds = " AND ".join([f"{k} = '{v}'" for k, v in f.items() if v is not None]) or "true"
    q["account_filter"] = V + f"SELECT * FROM c WHERE {conds}"
    q["churn_by_plan"] = V + (
        f"SELECT plan, n, churners, {rnd_sql(rate('churners', 'n'), 6)} AS churn_rate, "
        f"CASE WHEN {rate('churners', 'n')} > 0.15 THEN 'risk' WHEN {rate('churners', 'n')} > 0.06 THEN 'watch' ELSE 'hold' END AS severity "
        "FROM (SELECT plan, count(*) AS n, CAST(sum(churned) AS BIGINT) AS churners FROM c GROUP BY plan)")
    lv = params["churn_by_plan_fixed"]["levels"]
    vals = ", ".join(f"({i}, '{v}')" for i, v in enumerate(lv))
    q["churn_by_plan_fixed"] = V + (
        f"SELECT o.pos, o.plan, a.n, {rnd_sql('CAST(a.churners AS DOUBLE) / nullif(CAST(a.n AS DOUBLE), 0)', 6)} AS churn_rate "
        f"FROM (SELECT CAST(pos AS INTEGER) AS pos, plan FROM (VALUES {vals}) v(pos, plan)) o "
        "LEFT JOIN (SELECT plan, count(*) AS n, CAST(sum(churned) AS BIGINT) AS churners FROM c GROUP BY plan) a ON a.plan = o.plan")
    arms = " ".join(f"WHEN dorm BETWEEN {lo} AND {hi} THEN {i}" for i, (lo, hi, _) in enumerate(DORM_BINS))
    labs = " ".join(f"WHEN bin = {i} THEN '{lab}'" for i, (_, _, lab) in enumerate(DORM_BINS))
    q["churn_by_dormancy"] = V + (
        f"SELECT CAST(bin AS INTEGER) AS bin, CASE {labs} END AS bucket, n, churners, {rnd_sql(rate('churners', 'n'), 6)} AS churn_rate "
        f"FROM (SELECT CASE {arms} END AS bin, count(*) AS n, CAST(sum(churned) AS BIGINT) AS churners FROM c "
        f"WHERE (CASE {arms} END) IS NOT NULL GROUP BY 1)")
    q["dormancy_cube"] = V + (
        f"SELECT CAST(bin AS INTEGER) AS bin, gid, plan, region, contract, n, churners, {rnd_sql(rate('churners', 'n'), 6)} AS churn_rate "
        f"FROM (SELECT bin, plan, region, contract, CAST(grouping(plan, region, contract) AS BIGINT) AS gid, count(*) AS n, "
        f"CAST(sum(churned) AS BIGINT) AS churners FROM (SELECT *, CASE {arms} END AS bin FROM c) WHERE bin IS NOT NULL "
        "GROUP BY bin, CUBE (plan, region, contract))")
    parts = []
    for d, r in params["outreach_at_threshold"]["thresholds"]:
        hit = f"dorm >= {d} AND risk >= {float(r)}"
        parts.append(
            f"SELECT {d} AS dorm_min, CAST({float(r)} AS DOUBLE) AS risk_min, count(*) FILTER (WHERE {hit}) AS flagged, "
            f"{rnd_sql(rate(f'count(*) FILTER (WHERE {hit})', 'count(*)'), 6)} AS share_flagged, "
            f"CAST(coalesce(sum(churned) FILTER (WHERE {hit}), 0) AS BIGINT) AS caught, "
            f"{rnd_sql(rate(f'coalesce(sum(churned) FILTER (WHERE {hit}), 0)', 'sum(churned)'), 6)} AS capture, "
            f"{rnd_sql(rate(f'coalesce(sum(churned) FILTER (WHERE {hit}), 0)', f'count(*) FILTER (WHERE {hit})'), 6)} AS hit_rate, "
            f"{rnd_sql(f'coalesce(sum(CAST(mrr AS DECIMAL(18,2))) FILTER (WHERE {hit}), 0)', 2)} AS mrr_covered FROM c")
    q["outreach_at_threshold"] = V + " UNION ALL ".join(parts)
    q["outreach_grid"] = V + (
        ", g AS (SELECT d, r FROM range(0, 91) t(d), range(0, 96) u(r)),\n"
        "f AS (SELECT g.d, g.r, count(c.id) AS hn, coalesce(sum(c.churned), 0) AS hc, "
        "coalesce(sum(CAST(c.mrr AS DECIMAL(18,2))), 0) AS hm FROM g LEFT JOIN c ON c.dorm >= g.d AND c.risk >= g.r / 100.0 GROUP BY g.d, g.r),\n"
        "t AS (SELECT count(*) AS n, sum(churned) AS churners FROM c)\n"
        f"SELECT CAST(d AS INTEGER) AS dorm_min, CAST(r AS INTEGER) AS risk_pct, CAST(hn AS BIGINT) AS flagged, "
        f"{rnd_sql(rate('hn', 'n'), 6)} AS share_flagged, CAST(hc AS BIGINT) AS caught, "
        f"{rnd_sql(rate('hc', 'churners'), 6)} AS capture, {rnd_sql(rate('hc', 'hn'), 6)} AS hit_rate, "
        f"{rnd_sql('hm', 2)} AS mrr_covered FROM f, t")
    p = params["outreach_cube"]
    q["outreach_cube"] = V + (
        f", g AS (SELECT d * {p['dorm_step']} AS d, r * {p['risk_step']} AS r FROM range(0, {90 // p['dorm_step'] + 1}) t(d), "
        f"range(0, {95 // p['risk_step'] + 1}) u(r)),\n"
        "e AS (SELECT CAST(m AS BIGINT) AS gid, CASE WHEN m & 4 = 0 THEN plan END AS plan, CASE WHEN m & 2 = 0 THEN region END AS region, "
        "CASE WHEN m & 1 = 0 THEN contract END AS contract, dorm, risk, churned, CAST(mrr AS DECIMAL(18,2)) AS mrr FROM c, range(0, 8) t(m)),\n"
        "f AS (SELECT gid, plan, region, contract, d, r, count(*) AS n, sum(churned) AS churners, "
        "count(*) FILTER (dorm >= d AND risk >= r / 100.0) AS hn, coalesce(sum(churned) FILTER (dorm >= d AND risk >= r / 100.0), 0) AS hc, "
        "coalesce(sum(mrr) FILTER (dorm >= d AND risk >= r / 100.0), 0) AS hm FROM e, g GROUP BY ALL)\n"
        f"SELECT gid, plan, region, contract, CAST(d AS INTEGER) AS dorm_min, CAST(r AS INTEGER) AS risk_pct, CAST(hn AS BIGINT) AS flagged, "
        f"{rnd_sql(rate('hn', 'n'), 6)} AS share_flagged, CAST(hc AS BIGINT) AS caught, "
        f"{rnd_sql(rate('hc', 'churners'), 6)} AS capture, {rnd_sql(rate('hc', 'hn'), 6)} AS hit_rate, "
        f"{rnd_sql('hm', 2)} AS mrr_covered FROM f")
    kpi = lambda keys, src, med: (
        f"SELECT {keys}n, churners, {rnd_sql(rate('churners', 'n'), 6)} AS churn_rate, {rnd_sql('mrr_sum', 2)} AS mrr_sum, "
        f"{rnd_sql('mrr_lost', 2)} AS mrr_lost, {rnd_sql(rate('mrr_lost', 'mrr_sum'), 6)} AS lost_share, "
        f"coalesce({med}, 0.0) AS median_mrr FROM {src}")
    q["account_kpis"] = V + (
        ", a AS (SELECT count(*) AS n, CAST(sum(churned) AS BIGINT) AS churners, sum(CAST(mrr AS DECIMAL(18,2))) AS mrr_sum, "
        "coalesce(sum(CAST(mrr AS DECIMAL(18,2))) FILTER (WHERE churned = 1), 0) AS mrr_lost FROM c),\n"
        "m AS (SELECT mrr AS med FROM (SELECT mrr, row_number() OVER (ORDER BY mrr) - 1 AS i, count(*) OVER () AS k FROM c) WHERE i = k // 2)\n"
        + kpi("", "a LEFT JOIN m ON true", "m.med"))
    q["account_cube_all"] = V + (
        ", a AS (SELECT CAST(grouping(plan, region, contract) AS BIGINT) AS gid, plan, region, contract, count(*) AS n, "
        "CAST(sum(churned) AS BIGINT) AS churners, sum(CAST(mrr AS DECIMAL(18,2))) AS mrr_sum, "
        "coalesce(sum(CAST(mrr AS DECIMAL(18,2))) FILTER (WHERE churned = 1), 0) AS mrr_lost FROM c GROUP BY CUBE (plan, region, contract)),\n"
        "e AS (SELECT CAST(m AS BIGINT) AS gid, CASE WHEN m & 4 = 0 THEN plan END AS plan, CASE WHEN m & 2 = 0 THEN region END AS region, "
        "CASE WHEN m & 1 = 0 THEN contract END AS contract, mrr FROM c, range(0, 8) t(m)),\n"
        "r AS (SELECT *, row_number() OVER (PARTITION BY gid, plan, region, contract ORDER BY mrr) - 1 AS i, "
        "count(*) OVER (PARTITION BY gid, plan, region, contract) AS k FROM e),\n"
        "m AS (SELECT gid, plan, region, contract, mrr AS med FROM r WHERE i = k // 2)\n"
        + kpi("a.gid, a.plan, a.region, a.contract, ", "a LEFT JOIN m ON a.gid = m.gid AND a.plan IS NOT DISTINCT FROM m.plan "
              "AND a.region IS NOT DISTINCT FROM m.region AND a.contract IS NOT DISTINCT FROM m.contract", "m.med"))
    k = params["top_risk_accounts"]["k"]
    q["top_risk_accounts"] = V + f"SELECT id, plan, region, mrr, dorm, risk, churned FROM c ORDER BY risk DESC, id LIMIT {k}"
    q["decile_capture"] = V + (
        ", r AS (SELECT *, row_number() OVER (ORDER BY risk DESC, id) AS rk, count(*) OVER () AS n, sum(churned) OVER () AS tc FROM c)\n"
        f"SELECT CAST(count(*) FILTER (WHERE rk <= n // 10) AS BIGINT) AS top_n, "
        f"{rnd_sql('coalesce(sum(CAST(mrr AS DECIMAL(18,2))) FILTER (WHERE rk <= n // 10), 0)', 2)} AS mrr_at_risk, "
        f"CAST(coalesce(sum(churned) FILTER (WHERE rk <= n // 10), 0) AS BIGINT) AS churners_captured, "
        f"{rnd_sql(rate('coalesce(sum(churned) FILTER (WHERE rk <= n // 10), 0)', 'max(tc)'), 6)} AS capture FROM r")
    q["dict_plan_by_median"] = V + (
        f"SELECT plan, {rnd_sql('med', 4)} AS median_mrr, CAST(row_number() OVER (ORDER BY med, plan) - 1 AS INTEGER) AS code "
        "FROM (SELECT plan, quantile_cont(mrr, 0.5) AS med FROM c GROUP BY plan)")
    q["dict_alpha"] = V + ("SELECT region AS value, CAST(row_number() OVER (ORDER BY region) - 1 AS INTEGER) AS code "
                           "FROM (SELECT DISTINCT region FROM c)")
    pref = ", ".join(f"'{p}'" for p in PREFERRED_CONTRACTS)
    q["dict_preferred"] = V + (
        "SELECT contract AS value, CAST(row_number() OVER (ORDER BY nullif(list_position([" + pref + "], contract), 0) "
        "NULLS LAST, contract) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT contract FROM c)")
    percent = params["cube_sample_cap"]["percent"]
    q["cube_sample_cap"] = V + f"SELECT * FROM c WHERE ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT % 100 < {percent}"
    q["account_cube"] = V + (
        ", "
        "pc AS (SELECT plan, row_number() OVER (ORDER BY med, plan) - 1 AS plan_code FROM (SELECT plan, quantile_cont(mrr, 0.5) AS med FROM c GROUP BY plan)),\n"
        "rc AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS region_code FROM (SELECT DISTINCT region FROM c)),\n"
        "cc AS (SELECT contract, row_number() OVER (ORDER BY nullif(list_position([" + pref + "], contract), 0) NULLS LAST, contract) - 1 AS contract_code "
        "FROM (SELECT DISTINCT contract FROM c))\n"
        "SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, id, CAST(plan_code AS INTEGER) AS plan_code, "
        "CAST(region_code AS INTEGER) AS region_code, CAST(contract_code AS INTEGER) AS contract_code, "
        f"{rnd_sql('mrr', 2)} AS mrr, dorm, churned, {rnd_sql('risk', 4)} AS risk "
        "FROM c JOIN pc USING (plan) JOIN rc USING (region) JOIN cc USING (contract)")
    usd = lambda x: f"'$' || format('{{:,}}', CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT))"
    pct = lambda x: f"printf('%.1f%%', round_even(CAST({x} AS DOUBLE) * 100 * 10.0, 0) / 10.0)"
    q["report_kpi_lines"] = V + (
        ", a AS (SELECT count(*) AS n, CAST(sum(churned) AS BIGINT) AS churners, sum(CAST(mrr AS DECIMAL(18,2))) AS mrr_sum, "
        "coalesce(sum(CAST(mrr AS DECIMAL(18,2))) FILTER (WHERE churned = 1), 0) AS mrr_lost FROM c),\n"
        "m AS (SELECT mrr AS med FROM (SELECT mrr, row_number() OVER (ORDER BY mrr) - 1 AS i, count(*) OVER () AS k FROM c) WHERE i = k // 2),\n"
        "k AS (SELECT n, churners, round_even(" + rate('churners', 'n') + " * 1e6, 0) / 1e6 AS churn_rate, round_even(CAST(mrr_sum AS DOUBLE) * 100, 0) / 100 AS mrr_sum, "
        "round_even(CAST(mrr_lost AS DOUBLE) * 100, 0) / 100 AS mrr_lost, round_even(" + rate('mrr_lost', 'mrr_sum') + " * 1e6, 0) / 1e6 AS lost_share, "
        "coalesce(m.med, 0.0) AS median_mrr FROM a LEFT JOIN m ON true)\n"
        "SELECT * FROM (SELECT 1 AS line_no, 'Accounts: ' || format('{:,}', n) AS text FROM k UNION ALL "
        f"SELECT 2, 'Churn rate: ' || {pct('churn_rate')} || ' (' || format('{{:,}}', churners) || ' of ' || format('{{:,}}', n) || ' accounts)' FROM k UNION ALL "
        f"SELECT 3, 'Monthly revenue: ' || {usd('mrr_sum')} FROM k UNION ALL "
        f"SELECT 4, 'MRR lost to churn: ' || {usd('mrr_lost')} || ' (' || {pct('lost_share')} || ' of selected revenue)' FROM k UNION ALL "
        f"SELECT 5, 'Median MRR: ' || {usd('median_mrr')} FROM k)")
    la, lb = params["level_ratio"]["level_a"], params["level_ratio"]["level_b"]
    q["level_ratio"] = V + (
        f", a AS (SELECT CAST(sum(churned) FILTER (WHERE plan = '{la}') AS DOUBLE) / nullif(count(*) FILTER (WHERE plan = '{la}'), 0) AS ra, "
        f"CAST(sum(churned) FILTER (WHERE plan = '{lb}') AS DOUBLE) / nullif(count(*) FILTER (WHERE plan = '{lb}'), 0) AS rb FROM c)\n"
        f"SELECT '{la}' AS level_a, '{lb}' AS level_b, {rnd_sql('ra', 6)} AS rate_a, {rnd_sql('rb', 6)} AS rate_b, "
        f"{rnd_sql('ra / nullif(rb, 0)', 6)} AS ratio FROM a")
    return q


def retention_sql(params: dict) -> dict[str, str]:
    from ..operators.retention import SRC_NAMES
    V = with_views("sub", "wk", "weeks")
    coh = "(signup < 0 AND (churn IS NULL OR churn >= 0))"
    act = f"({coh} AND active = 1)"
    r = lambda a, b: rnd_sql(f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)", 6)
    q: dict[str, str] = {}
    q["nrr_cohort"] = V + f"SELECT account_id, region, signup, churn, active, prior, mrr FROM sub WHERE {coh}"
    q["retention_kpis"] = V + (
        f"SELECT gid, region, cohort, retained, {rnd_sql('coalesce(start_mrr, 0)', 2)} AS start_mrr, "
        f"{r('end_mrr', 'start_mrr')} AS nrr, {r('grr_mrr', 'start_mrr')} AS grr, {r('retained', 'cohort')} AS logo FROM ("
        "SELECT CAST(grouping(region) AS BIGINT) AS gid, region, "
        f"sum(CAST(prior AS DECIMAL(18,2))) FILTER (WHERE {coh}) AS start_mrr, "
        f"sum(CAST(mrr AS DECIMAL(18,2))) FILTER (WHERE {act}) AS end_mrr, "
        f"sum(least(CAST(mrr AS DECIMAL(18,2)), CAST(prior AS DECIMAL(18,2)))) FILTER (WHERE {act}) AS grr_mrr, "
        f"count(*) FILTER (WHERE {coh}) AS cohort, count(*) FILTER (WHERE {act}) AS retained "
        "FROM sub GROUP BY GROUPING SETS ((region), ()))")
    q["unit_economics"] = V + (
        ", a AS (SELECT CAST(grouping(region) AS BIGINT) AS gid, region, count(*) AS accounts, "
        "count(*) FILTER (WHERE active = 1) AS active, sum(CAST(mrr AS DECIMAL(18,2))) FILTER (WHERE active = 1) AS mrr, "
        "sum(CAST(cac AS DECIMAL(18,2))) AS cac_sum, count(*) FILTER (WHERE active = 0) AS churned, "
        "sum(tenure) FILTER (WHERE active = 0) AS tenure_sum FROM sub GROUP BY GROUPING SETS ((region), ())),\n"
        "b AS (SELECT *, coalesce(CAST(mrr AS DOUBLE) / nullif(CAST(active AS DOUBLE), 0), 0) AS arpa, "
        "coalesce(CAST(cac_sum AS DOUBLE) / nullif(CAST(accounts AS DOUBLE), 0), 0) AS cac_m, "
        "coalesce((CAST(tenure_sum AS DOUBLE) / nullif(CAST(churned AS DOUBLE), 0)) / 4.33, 0) AS ten_m FROM a),\n"
        "c AS (SELECT *, arpa * 0.78 * ten_m AS ltv FROM b)\n"
        f"SELECT gid, region, accounts, active, churned, {rnd_sql('coalesce(CAST(mrr AS DOUBLE), 0) * 12', 2)} AS arr, "
        f"{rnd_sql('arpa', 6)} AS arpa, {rnd_sql('cac_m', 6)} AS cac, {rnd_sql('ten_m', 6)} AS tenure_months, "
        f"{rnd_sql('ltv', 6)} AS ltv, {rnd_sql('cac_m / nullif(arpa * 0.78, 0)', 6)} AS cac_payback_months, "
        f"{rnd_sql('ltv / nullif(cac_m, 0)', 6)} AS ltv_cac FROM c")
    q["retention_curve"] = V + (
        ", g AS (SELECT channel, t FROM (SELECT DISTINCT channel FROM sub), range(0, 53) r(t)),\n"
        "c AS (SELECT g.channel, g.t, count(s.account_id) AS at_risk, count(s.account_id) FILTER (WHERE s.tenure >= g.t) AS retained "
        f"FROM g LEFT JOIN sub s ON s.channel = g.channel AND {26} - s.signup >= g.t GROUP BY g.channel, g.t),\n"
        "d AS (SELECT *, CASE WHEN at_risk > 0 THEN CAST(retained AS DOUBLE) / at_risk END AS raw FROM c)\n"
        "SELECT channel, CAST(t AS INTEGER) AS t, CAST(at_risk AS BIGINT) AS at_risk, CAST(retained AS BIGINT) AS retained, "
        f"{rnd_sql('coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0)', 6)} AS rate FROM d")
    q["sub_region_semi"] = V + "SELECT * FROM sub WHERE region IN (SELECT region FROM wk)"
    dict_cte = (
        ", d AS (SELECT dim, value, total, CAST(row_number() OVER (PARTITION BY dim ORDER BY total DESC, value) - 1 AS INTEGER) AS code FROM ("
        "SELECT 'category' AS dim, category AS value, CAST(sum(gdv) AS DOUBLE) AS total FROM wk GROUP BY category UNION ALL "
        "SELECT 'region', region, CAST(sum(gdv) AS DOUBLE) FROM wk GROUP BY region UNION ALL "
        "SELECT 'channel', channel, CAST(sum(camp) AS DOUBLE) FROM wk GROUP BY channel))\n")
    q["dict_by_sum"] = V + dict_cte + f"SELECT dim, value, {rnd_sql('total', 4)} AS total, code FROM d"
    fields = ["camp", "funded", "fast", "goal", "gdv", "don", "donors", "retdon", "fromdon", "repeatorg",
              "tips", "procrev", "proccost", "rev", "refunds", "refamt", "cb", "fraud"]
    cols = ", ".join(f"CAST(round_even({f}, 0) AS BIGINT) AS {f}" if f in MONEY_SUMS else f"CAST({f} AS BIGINT) AS {f}"
                     for f in fields)
    q["weekly_cube"] = V + dict_cte + (
        f"SELECT CAST(weeks.week_idx AS INTEGER) AS w, dc.code AS cat, dr.code AS reg, dh.code AS ch, {cols}, "
        "paydays_x100 / 100 AS paydays, paid, CAST(spend AS BIGINT) AS spend FROM wk JOIN weeks USING (week) "
        "JOIN d dc ON dc.dim = 'category' AND dc.value = wk.category JOIN d dr ON dr.dim = 'region' AND dr.value = wk.region "
        "JOIN d dh ON dh.dim = 'channel' AND dh.value = wk.channel")
    q["sub_cube"] = V + dict_cte + (
        ", s AS (SELECT * FROM sub WHERE region IN (SELECT region FROM wk)),\n"
        "t AS (SELECT tier, CAST(row_number() OVER (ORDER BY tier) - 1 AS INTEGER) AS tier_code FROM (SELECT DISTINCT tier FROM s)),\n"
        "h AS (SELECT channel, CAST(row_number() OVER (ORDER BY channel) - 1 AS INTEGER) AS channel_code FROM (SELECT DISTINCT channel FROM s))\n"
        "SELECT account_id, t.tier_code AS tier, dr.code AS reg, h.channel_code AS ch, signup, churn, active, tenure, "
        f"{rnd_sql('prior', 2)} AS prior, {rnd_sql('mrr', 2)} AS mrr, {rnd_sql('cac', 2)} AS cac "
        "FROM s JOIN t USING (tier) JOIN h USING (channel) JOIN d dr ON dr.dim = 'region' AND dr.value = s.region")
    # decode(encode(wk)) is wk at cube precision: checked against the fact itself
    q["weekly_cube_decoded"] = V + (
        "SELECT week, category, region, channel, CAST(camp AS BIGINT) AS camp, "
        "CAST(round_even(gdv, 0) AS BIGINT) AS gdv, CAST(don AS BIGINT) AS don, "
        "CAST(spend AS BIGINT) AS spend FROM wk")
    money = {"goal", "gdv", "tips", "procrev", "proccost", "rev", "refamt"}
    ren = ", ".join(
        (f"{rnd_sql(k, 4)} AS {v}" if k in money else
         ("paydays_x100 / 100 AS payout_days" if k == "paydays" else f"{k} AS {v}"))
        for k, v in SRC_NAMES.items())
    q["wk_rename"] = V + f"SELECT week, category, region, channel, {ren} FROM wk"
    return q


# The orders schema as Spark names its types (for the profile oracle).
ORDERS_SCHEMA = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
EVENTS_SCHEMA = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
                 ("value", "double"), ("props", "string")]
DOCUMENTS_SCHEMA = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
ACCT_SCHEMA = [("id", "bigint"), ("plan", "string"), ("region", "string"), ("contract", "string"),
               ("mrr", "double"), ("dorm", "bigint"), ("churned", "int"), ("risk", "double"), ("leak_flag", "int")]


def _missing(c, t):
    return f"({c} IS NULL OR isnan({c}))" if t == "double" else f"({c} IS NULL)"


def auc_sql(src: str, score: str, y: str, label: str) -> str:
    """Average-rank Mann-Whitney AUC of one score column as a SELECT."""
    return (
        f"SELECT '{label}' AS column, CASE WHEN coalesce(P, 0) = 0 OR coalesce(N, 0) = 0 THEN 0.5 "
        "ELSE (sr - P * (P + 1) / 2.0) / (P * N) END AS auc, "
        "CAST(coalesce(P, 0) AS BIGINT) AS n_pos, CAST(coalesce(N, 0) AS BIGINT) AS n_neg FROM ("
        f"SELECT sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS sr, sum(y) AS P, count(*) - sum(y) AS N FROM ("
        f"SELECT {y} AS y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r "
        f"FROM (SELECT CAST({score} AS DOUBLE) AS s, {y} FROM {src}) WHERE s IS NOT NULL AND NOT isnan(s)))")


def profile_sql(table: str, cols: list, target: str) -> dict[str, str]:
    """The eight profile cards of one table, written directly against it."""
    q: dict[str, str] = {}
    T = table
    q["profile_shape"] = f"SELECT '{T}' AS \"table\", count(*) AS n_rows, {len(cols)} AS n_cols FROM {T}"
    q["profile_columns"] = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS column, '{t}' AS dtype, "
        f"{rnd_sql(f'avg(CASE WHEN {_missing(c, t)} THEN 1.0 ELSE 0.0 END) * 100', 2)} AS null_pct FROM {T}"
        for i, (c, t) in enumerate(cols))
    q["profile_distinct"] = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS column, count(DISTINCT {c}) AS n_unique FROM {T}" for i, (c, t) in enumerate(cols))
    num = [(c, t) for c, t in cols if t in ("bigint", "double", "int")]
    q["profile_numeric"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column, {rnd_sql(f'min({c})', 3)} AS min, {rnd_sql(f'quantile_cont({c}, 0.25)', 3)} AS p25, "
        f"{rnd_sql(f'quantile_cont({c}, 0.5)', 3)} AS median, {rnd_sql(f'quantile_cont({c}, 0.75)', 3)} AS p75, "
        f"{rnd_sql(f'max({c})', 3)} AS max, {rnd_sql(f'avg({c})', 3)} AS mean FROM {T} WHERE {c} IS NOT NULL"
        for c, t in num)
    txt = [(c, t) for c, t in cols if (c, t) not in num]
    q["profile_top_values"] = (
        "SELECT \"column\", value, count FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS k FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {T} "
                             f"WHERE {c} IS NOT NULL GROUP BY 2" for c, t in txt)
        + ")) WHERE k <= 8")
    q["profile_likely_ids"] = (
        "SELECT \"column\", n_unique FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_unique FROM {T}" for c, t in cols)
        + f") WHERE n_unique > (SELECT count(*) FROM {T}) * 0.95")
    dates = [(c, t) for c, t in cols if t in ("string", "timestamp_ntz", "date", "timestamp")]
    q["profile_likely_dates"] = " UNION ALL ".join(
        (f"SELECT '{c}' AS column, {rnd_sql('coalesce(s, 0.0)', 4)} AS parse_share, coalesce(s, 0.0) > 0.9 AS likely_date FROM ("
         + (f"SELECT CASE WHEN count({c}) > 0 THEN 1.0 END AS s FROM {T}" if t != "string" else
            f"SELECT CAST(count(coalesce(try_cast({c} AS TIMESTAMP), try_strptime({c}, ['%m/%d/%Y', '%d.%m.%Y', '%Y/%m/%d', '%Y%m%d']))) AS DOUBLE) / nullif(CAST(count({c}) AS DOUBLE), 0) AS s FROM {T}")
         + ")") for c, t in dates)
    q["profile_target"] = (
        f"SELECT CAST({target} AS VARCHAR) AS value, {rnd_sql(f'count(*) / (SELECT count(*) FROM {T})', 4)} AS share, "
        f"(SELECT count(DISTINCT {target}) FROM {T}) = 2 AS is_binary FROM {T} GROUP BY {target} "
        f"ORDER BY count(*) DESC, {target} NULLS FIRST LIMIT 10")
    return q


def card_sql(table: str, cols: list, target: str) -> str:
    """The sections of one table's data card below each other."""
    q = profile_sql(table, cols, target)
    whole = ", ".join(c for c, _ in cols)
    numeric = " UNION ALL ".join(
        f"SELECT 'numeric' AS section, \"column\", '{k}' AS key, NULL::BIGINT AS n, {k} AS x FROM ({q['profile_numeric']})"
        for k in ("min", "p25", "median", "p75", "max", "mean"))
    dup = f"(SELECT count(*) AS k FROM {table} GROUP BY {whole} HAVING count(*) > 1)"
    parts = [
        f"SELECT 'shape' AS section, NULL::VARCHAR AS \"column\", 'rows' AS key, count(*) AS n, NULL::DOUBLE AS x FROM {table}",
        f"SELECT 'shape', NULL, 'columns', {len(cols)}, NULL",
        f"SELECT 'columns', \"column\", dtype, pos, null_pct FROM ({q['profile_columns']})",
        f"SELECT 'distinct', \"column\", NULL, n_unique, NULL FROM ({q['profile_distinct']})",
        f"SELECT 'likely id', \"column\", NULL, n_unique, NULL FROM ({q['profile_likely_ids']})",
        f"SELECT 'top values', \"column\", value, count, NULL FROM ({q['profile_top_values']})",
        f"SELECT 'likely date', \"column\", CAST(likely_date AS VARCHAR), NULL, parse_share FROM ({q['profile_likely_dates']})",
        f"SELECT 'target', '{target}', value, NULL, share FROM ({q['profile_target']})",
        f"SELECT 'duplicates', NULL, 'surplus', coalesce(sum(k - 1), 0)::BIGINT, NULL FROM {dup}",
        f"SELECT 'duplicates', NULL, 'members', coalesce(sum(k), 0)::BIGINT, NULL FROM {dup}", numeric]
    return f"SELECT '{table}' AS dataset, * FROM ({' UNION ALL '.join(parts)})"


def date_format_sql() -> str:
    """Shapes and readings of the dated orders, from the same texts made with strftime."""
    mixed = ("CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%b %d, %Y') "
             "WHEN 2 THEN strftime(o_orderdate, '%d %B %Y') ELSE strftime(o_orderdate, '%Y%m%d') END")
    two = "(CASE WHEN len(y) > 2 THEN try_cast(y AS INT) WHEN try_cast(y AS INT) < 69 THEN y::INT + 2000 ELSE y::INT + 1900 END)"
    day = lambda y, m, d: f"(try_cast(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || lpad(({d})::VARCHAR, 2, '0') AS DATE) IS NOT NULL)"
    return f"""
WITH c AS (
  SELECT 'us' AS col, strftime(o_orderdate, '%m/%d/%Y') AS v FROM orders
  UNION ALL SELECT 'eu', strftime(o_orderdate, '%d.%m.%y') FROM orders
  UNION ALL SELECT 'early', strftime(o_orderdate, '%d-%m-%Y') FROM orders WHERE day(o_orderdate) <= 12
  UNION ALL SELECT 'mixed', {mixed} FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
s AS (
  SELECT col, v, CASE
    WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN 'year-month-day'
    WHEN regexp_full_match(v, '[0-9]{{8}}') THEN 'yearmonthday'
    WHEN regexp_full_match(v, '[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{4}}|[0-9]{{2}})') THEN 'n/n/year'
    WHEN regexp_full_match(v, '[0-9]{{1,2}}[.][0-9]{{1,2}}[.]([0-9]{{4}}|[0-9]{{2}})') THEN 'n.n.year'
    WHEN regexp_full_match(v, '[0-9]{{1,2}}-[0-9]{{1,2}}-([0-9]{{4}}|[0-9]{{2}})') THEN 'n-n-year'
    WHEN regexp_full_match(v, '[0-9]{{1,2}} [A-Z][a-z]+ [0-9]{{4}}') THEN 'day name year'
    WHEN regexp_full_match(v, '[A-Z][a-z]+ [0-9]{{1,2}}, [0-9]{{4}}') THEN 'name day year' END AS shape
  FROM c WHERE v IS NOT NULL),
p AS (
  SELECT col, shape, regexp_extract_all(v, '[0-9]+|[A-Za-z]+') AS t, v FROM s),
r AS (
  SELECT col, shape,
    CASE WHEN shape LIKE 'n%' AND shape <> 'name day year' THEN (SELECT {day(two, 'try_cast(t[2] AS INT)', 'try_cast(t[1] AS INT)')} FROM (SELECT t[3] AS y))
         WHEN shape IS NOT NULL THEN true END AS dmy,
    CASE WHEN shape LIKE 'n%' AND shape <> 'name day year' THEN (SELECT {day(two, 'try_cast(t[1] AS INT)', 'try_cast(t[2] AS INT)')} FROM (SELECT t[3] AS y))
         WHEN shape IS NOT NULL THEN true END AS mdy
  FROM p),
g AS (
  SELECT col, CASE WHEN dmy OR mdy THEN shape END AS shape, count(*) AS n,
    count(*) FILTER (dmy AND NOT mdy) AS only_d, count(*) FILTER (mdy AND NOT dmy) AS only_m
  FROM r GROUP BY 1, 2),
o AS (
  SELECT *, sum(n) OVER (PARTITION BY col) AS whole,
    CASE WHEN shape NOT IN ('n/n/year', 'n.n.year', 'n-n-year') THEN '' WHEN only_d > only_m THEN 'day first' ELSE 'month first' END AS ord
  FROM g),
z AS (
  SELECT col, shape, ord, whole, n - CASE ord WHEN 'day first' THEN only_m WHEN 'month first' THEN only_d ELSE 0 END AS n,
    CASE ord WHEN 'day first' THEN only_d WHEN 'month first' THEN only_m ELSE 0 END AS decisive
  FROM o WHERE shape IS NOT NULL)
SELECT col AS "column", shape AS format, ord AS "order", n, decisive, {rnd_sql('n::DOUBLE / whole', 4)} AS share,
  row_number() OVER (PARTITION BY col ORDER BY n DESC, shape) = 1 AS chosen
FROM z"""


def profile_checks_sql(params: dict) -> dict[str, str]:
    q: dict[str, str] = profile_sql("orders", ORDERS_SCHEMA, params["profile_target"]["target"])
    for name, sql in profile_sql("events", EVENTS_SCHEMA, params["profile_target_events"]["target"]).items():
        q[f"{name}_events"] = sql
    q["data_card"] = " UNION ALL ".join(card_sql(t, cols, params["data_card"][t]) for t, cols in (
        ("orders", ORDERS_SCHEMA), ("events", EVENTS_SCHEMA), ("documents", DOCUMENTS_SCHEMA)))
    q["profile_date_format"] = date_format_sql()
    price = ("CASE WHEN o_orderkey % 13 = 0 THEN ['', 'NA', 'N/A', 'NaN', 'nan', 'NULL', 'null', 'None'][o_orderkey % 8 + 1] "
             "WHEN o_orderkey % 103 = 0 THEN 'about 5' ELSE CAST(o_totalprice AS VARCHAR) END")
    broken = "o_orderkey % 101 = 0"
    unfit = "(o_orderkey % 103 = 0 AND o_orderkey % 13 <> 0)"
    types = (("key", "bigint"), ("price", "string"), ("day", "date"), ("even", "boolean"), ("note", "string"),
             ("amount", "double"), ("kind", "string"), ("nothing", "string"))
    q["scan_csv_schema"] = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS \"column\", '{t}' AS type" for i, (c, t) in enumerate(types)) \
        + " FROM (SELECT count(*) AS n FROM orders) WHERE n > 0"
    q["scan_csv_inferred"] = (
        "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS price, CAST(o_orderdate AS DATE) AS day, "
        "o_orderkey % 2 = 0 AS even, o_orderpriority || ', \"x\"' AS note, "
        "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 1500.0 END::DOUBLE AS amount, 'a' AS kind, NULL::VARCHAR AS nothing "
        f"FROM orders WHERE NOT ({broken}) AND NOT {unfit}")
    q["scan_csv_rejects"] = (
        f"SELECT CASE WHEN {broken} THEN 'fields' ELSE 'type: price' END AS reason, o_orderkey || ',' || {price} || ',' || "
        "strftime(o_orderdate, '%Y-%m-%d') || ',' || CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'false' END || ',\"' || o_orderpriority "
        "|| ', \"\"x\"\"\",' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '1.5e3' END || ',' || "
        f"CASE WHEN {broken} THEN 'a,b' ELSE 'a' END || ',None' AS record FROM orders WHERE {broken} OR {unfit}")
    dup = lambda name, keys, src: (
        f"SELECT '{name}' AS dataset, sum(n) AS rows, sum(n - 1) AS surplus, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS members "
        f"FROM (SELECT count(*) AS n FROM (SELECT {'*' if keys == 'ALL' else keys} FROM {src}) t GROUP BY "
        f"{'hash(t), t' if keys == 'ALL' else keys})")
    both = (dup("documents.text", "text", "documents") + " UNION ALL "
            + dup("documents", "ALL", "documents") + " UNION ALL " + dup("lineitem", "ALL", "lineitem"))
    q["dup_surplus"] = f"SELECT dataset, CAST(rows AS BIGINT) AS rows, CAST(surplus AS BIGINT) AS surplus FROM ({both})"
    q["dup_members"] = f"SELECT dataset, CAST(rows AS BIGINT) AS rows, CAST(members AS BIGINT) AS members FROM ({both})"
    q["label_feature_join"] = ("SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang, d.source "
                               "FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
    # checks on the account snapshot (target churned)
    V = with_views("acct")
    q["rank_auc"] = V + f"SELECT {rnd_sql('auc', 6)} AS auc, n_pos, n_neg FROM ({auc_sql('acct', 'risk', 'churned', 'risk')})"
    parts = []
    for c, t in ACCT_SCHEMA:
        if c == "churned":
            continue
        if t == "string":
            score = f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c}) - 1 END"
            src = f"(SELECT {score} AS sc, churned FROM acct)"
            parts.append(auc_sql(src, "sc", "churned", c))
        else:
            parts.append(auc_sql("acct", c, "churned", c))
    q["leakage_scan"] = V + (
        f"SELECT \"column\", {rnd_sql('greatest(auc, 1 - auc)', 4)} AS univariate_auc, greatest(auc, 1 - auc) >= 0.9 AS flagged "
        f"FROM ({' UNION ALL '.join(parts)})")
    longv = " UNION ALL ".join(f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, churned AS y FROM acct"
                               for c, t in ACCT_SCHEMA if c != "churned")
    lv = (f", lg AS ({longv}),\n"
          "elig AS (SELECT \"column\" FROM lg WHERE value IS NOT NULL GROUP BY \"column\" HAVING count(DISTINCT value) <= 20),\n"
          "lv AS (SELECT \"column\", value, min(y) AS ymin, max(y) AS ymax FROM lg WHERE value IS NOT NULL AND y IS NOT NULL "
          "AND \"column\" IN (SELECT \"column\" FROM elig) GROUP BY \"column\", value)\n")
    q["one_sided_columns"] = V + lv + (
        "SELECT \"column\", count(*) AS n_levels, bool_and(ymin = ymax) AND count(DISTINCT ymin) = 2 AS one_sided FROM lv GROUP BY \"column\"")
    q["one_sided_levels"] = V + lv + "SELECT \"column\", value, ymin AS only_class FROM lv WHERE ymin = ymax"
    q["baselines"] = V + (
        f"SELECT {rnd_sql('greatest(p, 1 - p)', 4)} AS majority_class_accuracy, {rnd_sql('p', 4)} AS positive_rate, "
        "CAST(0.5 AS DOUBLE) AS random_auc FROM (SELECT avg(CAST(churned AS DOUBLE)) AS p FROM acct)")
    allc = ", ".join(c for c, _ in ACCT_SCHEMA)
    q["validity_verdict"] = V + lv + (
        f", sus AS (SELECT count(*) AS k FROM ({' UNION ALL '.join(parts)}) WHERE greatest(auc, 1 - auc) >= 0.9),\n"
        "one AS (SELECT count(*) AS k FROM (SELECT \"column\" FROM lv GROUP BY \"column\" HAVING bool_and(ymin = ymax) AND count(DISTINCT ymin) = 2)),\n"
        f"dup AS (SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS k FROM (SELECT count(*) AS n FROM acct GROUP BY {allc}))\n"
        "SELECT (SELECT count(*) FROM acct) AS n_rows, dup.k AS duplicate_rows, sus.k AS n_suspects, one.k AS n_one_sided, "
        "CASE WHEN sus.k = 0 AND one.k = 0 THEN 'clean' ELSE 'review_required' END AS verdict FROM sus, one, dup")
    q["crosstab"] = V + ("SELECT contract AS value, CAST(churned AS VARCHAR) AS class, count(*) AS n FROM acct "
                         "WHERE contract IS NOT NULL AND churned IS NOT NULL GROUP BY contract, churned")
    return q


def text_sql(params: dict) -> dict[str, str]:
    from ..functions.text import CASE_FIXES, HTML_ESCAPES, TRUNCATION_MARKER
    limit = params["truncate_middle"]["limit"]
    q: dict[str, str] = {}
    esc = "coalesce(CAST(text AS VARCHAR), '')"
    for a, b in HTML_ESCAPES:
        esc = f"replace({esc}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    q["html_escape"] = f"SELECT doc_id, {esc} AS escaped FROM documents"
    half = limit // 2
    marker = TRUNCATION_MARKER.replace("\n", "' || chr(10) || '")
    tr = f"CASE WHEN length(text) > {limit} THEN left(text, {half}) || '{marker}' || right(text, {half}) ELSE text END"
    q["truncate_middle"] = f"SELECT doc_id, {tr} AS truncated, CAST(length({tr}) AS INTEGER) AS n_chars_out FROM documents"
    q["collapse_ws"] = r"SELECT doc_id, regexp_replace(text, '[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g') AS collapsed FROM documents"
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    braces = r"(?s)[\{\[].*[\}\]]"
    q["json_recover"] = (
        "WITH w AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'error: ' || event_type "
        "WHEN event_id % 3 = 0 THEN '```json' || chr(10) || props || chr(10) || '```' "
        "WHEN event_id % 3 = 1 THEN 'Result: ' || props || ' (end)' ELSE props END AS raw FROM events),\n"
        f"a AS (SELECT event_id, {strip('raw')} AS raw FROM w),\n"
        f"b AS (SELECT event_id, CASE WHEN regexp_matches(raw, '{fence}') THEN {strip(f'regexp_extract(raw, {chr(39)}{fence}{chr(39)}, 1)')} "
        "ELSE raw END AS t FROM a),\n"
        f"c AS (SELECT event_id, t, regexp_extract(t, '{braces}', 0) AS span FROM b),\n"
        "d AS (SELECT event_id, CASE WHEN json_valid(t) THEN t WHEN span <> '' AND json_valid(span) THEN span END AS recovered FROM c)\n"
        "SELECT event_id, recovered, CAST(json_extract_string(recovered, '$.k') AS INTEGER) AS k, recovered IS NOT NULL AS ok FROM d")
    pack = ("SELECT conv_id, count(*) AS n_turns, string_agg('[' || CAST(turn AS VARCHAR) || ' ' || coalesce(role, '?') || '] ' "
            "|| coalesce(text, ''), chr(10) ORDER BY turn) AS pack FROM ")
    q["transcript_pack"] = pack + "conversations GROUP BY conv_id"
    q["transcript_last"] = pack + (
        "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) "
        f"WHERE r <= {params['transcript_last']['turns']} GROUP BY conv_id")
    q["transcript_parts"] = (
        "WITH t AS (SELECT *, '[' || CAST(turn AS VARCHAR) || ' ' || coalesce(role, '?') || '] ' || coalesce(text, '') AS p FROM conversations),\n"
        "s AS (SELECT conv_id, turn, sum(length(p) + 1) AS n FROM t GROUP BY conv_id, turn),\n"
        "b AS (SELECT conv_id, turn, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING "
        f"AND 1 PRECEDING), 0) // {params['transcript_parts']['part_chars']} AS BIGINT) AS part FROM s)\n"
        "SELECT conv_id, part, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn, "
        "string_agg(p, chr(10) ORDER BY turn) AS pack FROM t JOIN b USING (conv_id, turn) GROUP BY conv_id, part")
    V = with_views("wk")
    pct = lambda x, d: f"printf('%.{d}f%%', round_even(CAST({x} AS DOUBLE) * 100 * {float(10 ** d)}, 0) / {float(10 ** d)})"
    ints = lambda x: f"format('{{:,}}', CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT))"
    q["format_metrics"] = V + (
        f"SELECT week, {pct(ratio_sql('fundedRate'), 1)} AS funded_rate, {pct(ratio_sql('takeRate'), 2)} AS take_rate, "
        f"{ints('don')} AS donations, '$' || printf('%.2f', round_even({ratio_sql('avgDonation')} * 100.0, 0) / 100.0) AS avg_donation, "
        "CASE WHEN CAST(gdv AS DOUBLE) >= 1e6 THEN '$' || printf('%.2f', round_even(CAST(gdv AS DOUBLE) / 1e6 * 100.0, 0) / 100.0) || 'M' "
        "WHEN CAST(gdv AS DOUBLE) >= 1e3 THEN '$' || printf('%.0f', round_even(CAST(gdv AS DOUBLE) / 1e3, 0)) || 'K' "
        f"ELSE '$' || {ints('gdv')} END AS gdv, '$' || {ints('rev')} AS net_revenue "
        f"FROM ({agg('week')})")
    q["format_dates"] = (with_views("weeks") +
                         "SELECT week, strftime(week, '%b %-d, %Y') AS label, strftime(week, '%m/%d') AS axis FROM weeks")
    x = "(CAST(o_totalprice AS DECIMAL(18,2)) * 0.125)"
    q["scalar_rounding"] = (f"SELECT o_orderkey, {rnd_sql(x, 5)} AS x, {rnd_sql(f'round_even({x}, 2)', 5)} AS half_even, "
                            f"{rnd_sql(f'round({x}, 2)', 5)} AS half_up, CAST(floor({x} + 0.5) AS BIGINT) AS js_round FROM orders")
    q["bin_right_closed"] = with_views("acct") + (
        "SELECT id, CAST(dorm * 1.5 AS DOUBLE) AS x, CASE WHEN dorm * 1.5 >= 0 AND dorm * 1.5 <= 7 THEN '0-7' "
        "WHEN dorm * 1.5 > 7 AND dorm * 1.5 <= 14 THEN '8-14' WHEN dorm * 1.5 > 14 AND dorm * 1.5 <= 30 THEN '15-30' "
        "WHEN dorm * 1.5 > 30 AND dorm * 1.5 <= 60 THEN '31-60' WHEN dorm * 1.5 > 60 AND dorm * 1.5 <= 200 THEN '60+' END AS bin FROM acct")
    title = ("array_to_string(list_transform(string_split(lower(raw), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')")
    fix = title
    for a, b in CASE_FIXES.items():
        fix = f"CASE WHEN {fix} = '{a}' THEN '{b}' ELSE {fix} END"
    q["clean_category_case"] = with_views("geo") + (
        f"SELECT c_custkey, raw, {fix} AS cleaned FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(r_name) "
        "ELSE r_name END AS raw FROM geo)")
    oh = params["one_hot_dummy_na"]["levels"]
    cols = ["id"]
    for c, levels in oh.items():
        for lv in levels:
            cols.append(f"CASE WHEN {c} = '{lv}' THEN 1 ELSE 0 END AS \"{c}_{lv}\"")
        cols.append(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS \"{c}_nan\"")
    q["one_hot_long"] = with_views("acct") + " UNION ALL ".join(
        f"SELECT id, '{c}' AS column, {c} AS level FROM acct" for c in ("plan", "region", "contract"))
    q["one_hot_dummy_na"] = with_views("acct") + f"SELECT {', '.join(cols)} FROM acct"
    return q


def extra_sql(params: dict) -> dict[str, str]:
    q: dict[str, str] = {}
    V = with_views("acct") + (", c AS (SELECT id, plan, region, contract, mrr, dorm, churned, risk FROM acct "
                              "WHERE id IS NOT NULL AND plan IS NOT NULL AND region IS NOT NULL AND contract IS NOT NULL "
                              "AND mrr IS NOT NULL AND dorm IS NOT NULL AND churned IS NOT NULL AND risk IS NOT NULL)\n")
    f = params["account_filter"]
    conds = " AND ".join([f"{k} = '{v}'" for k, v in f.items() if v is not None]) or "true"
    scope = ", ".join(f"{k} {f[k]}" for k in ("plan", "contract", "region") if f[k] is not None) or "all accounts"
    q["scope_sentence"] = V + (
        f"SELECT count(*) AS n, format('{{:,}}', count(*)) || ' accounts: {scope}' AS sentence FROM c WHERE {conds}")
    pct = params["union_all_dupes"]["pct"]
    dup = (f"SELECT * FROM c UNION ALL SELECT * FROM c WHERE "
           f"('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT % 100 < {pct}")
    q["union_all_dupes"] = V + dup
    q["dedupe"] = V + f"SELECT DISTINCT * FROM ({dup})"
    V2 = with_views("acct")
    parts = []
    for c, t in ACCT_SCHEMA:
        if c == "churned":
            continue
        if t == "string":
            score = f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c}) - 1 END"
            parts.append(auc_sql(f"(SELECT {score} AS sc, churned FROM acct)", "sc", "churned", c))
        else:
            parts.append(auc_sql("acct", c, "churned", c))
    longv = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, churned AS y FROM acct"
                               for c, t in ACCT_SCHEMA if c != "churned")
    allc = ", ".join(c for c, _ in ACCT_SCHEMA)
    q["validity_report"] = V2 + (
        f", s AS (SELECT \"column\" AS col, {rnd_sql('greatest(auc, 1 - auc)', 4)} AS a FROM ({' UNION ALL '.join(parts)}) "
        "WHERE greatest(auc, 1 - auc) >= 0.9),\n"
        f"lg AS ({longv}),\n"
        "elig AS (SELECT col FROM lg WHERE value IS NOT NULL GROUP BY col HAVING count(DISTINCT value) <= 20),\n"
        "lv AS (SELECT col, value, min(y) AS ymin, max(y) AS ymax FROM lg WHERE value IS NOT NULL AND y IS NOT NULL "
        "AND col IN (SELECT col FROM elig) GROUP BY col, value),\n"
        "o AS (SELECT col FROM lv GROUP BY col HAVING bool_and(ymin = ymax) AND count(DISTINCT ymin) = 2),\n"
        f"d AS (SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS k FROM (SELECT count(*) AS n FROM acct GROUP BY {allc})),\n"
        "b AS (SELECT avg(CAST(churned AS DOUBLE)) AS p FROM acct)\n"
        "SELECT CAST(line_no AS INTEGER) AS line_no, text FROM (SELECT 1 AS line_no, CAST((SELECT count(*) FROM acct) AS VARCHAR) || ' rows, ' || CAST(d.k AS VARCHAR) || ' of them members of duplicate sets' AS text FROM d "
        "UNION ALL SELECT 2, 'A constant guess reaches accuracy ' || CAST(" + rnd_sql('greatest(p, 1 - p)', 4)
        + " AS VARCHAR) || ' and AUC 0.5; share of positives ' || CAST(" + rnd_sql('p', 4) + " AS VARCHAR) || '.' FROM b "
        "UNION ALL SELECT 10, 'Columns that rank the target almost without error by themselves:' WHERE (SELECT count(*) FROM s) > 0 "
        "UNION ALL SELECT 10 + row_number() OVER (ORDER BY a DESC, col), '* ' || col || ': AUC ' || CAST(a AS VARCHAR) FROM s "
        "UNION ALL SELECT 1000, 'Columns whose every level belongs to one class: ' "
        "|| string_agg(col, ', ' ORDER BY col) FROM o HAVING count(*) > 0 "
        "UNION ALL SELECT 2000, 'No column gives the target away.' WHERE (SELECT count(*) FROM s) = 0 AND (SELECT count(*) FROM o) = 0)")
    return q
