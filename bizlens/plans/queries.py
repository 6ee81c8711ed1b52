"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the views) and returns a lazy
DataFrame; parameters live in ``PARAMS`` so the oracle SQL uses the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import scaled_watch
from ..functions.numeric import rnd
from ..operators import accounts as A
from ..operators import checks as C
from ..operators import profile as P
from ..operators import retention as R
from ..operators import textjobs as X
from ..operators import weekly as W
from ..operators.ranking import rank_auc
from ..session import case_sensitive_session, use_query_conf
from ..sources.files import read_optional
from ..sources.scratch import scratch_path
from ..sources.tables import Tables
from . import views

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# Guards of the movers list are absolute counts sized for the reference's sample;
# on the driver tables they are scaled (a unit test covers the original values).
MOVER_GUARD_SCALE = 0.02

PARAMS = {
    "weekly_filter": {"category": None, "region": "ASIA", "channel": "BUILDING"},
    "fraud_early_late": {"category": "1-URGENT", "split_idx": 14},
    "segment_table": {"warn_refund": 0.012},
    "movers": {"watch": scaled_watch(MOVER_GUARD_SCALE), "top": 7},
    "account_filter": {"plan": "BUILDING", "region": None, "contract": "multi-year"},
    "churn_by_plan_fixed": {"levels": ["HOUSEHOLD", "AUTOMOBILE", "BUILDING", "FURNITURE",
                                       "MACHINERY", "GOVERNMENT"]},
    "outreach_at_threshold": {"thresholds": [(14, 0.30), (30, 0.30)]},
    "outreach_cube": {"dorm_step": 10, "risk_step": 5},
    "top_risk_accounts": {"k": 12},
    "cube_sample_cap": {"percent": 40},
    "truncate_middle": {"limit": 6000},
    "transcript_last": {"turns": 8},
    "transcript_parts": {"part_chars": 2_000_000},
    "level_ratio": {"level_a": "AUTOMOBILE", "level_b": "BUILDING"},
    "profile_target": {"target": "o_orderstatus"},
    "profile_target_events": {"target": "event_type"},
    "data_card": {"orders": "o_orderstatus", "events": "event_type", "documents": "lang"},
    "union_all_dupes": {"pct": 5},
    # TPC-H market segments and region names, and the contract classes.
    "one_hot_dummy_na": {"levels": {
        "plan": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
        "contract": ["annual", "monthly", "multi-year"]}},
}
PROFILED = "orders"


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


_VIEWS: dict = {}
_VIEWS_LOCK = __import__("threading").Lock()


def _app_key(spark: SparkSession):
    try:
        return spark.sparkContext.applicationId
    except Exception:  # e.g. a Spark Connect session has no SparkContext
        return spark.conf.get("spark.app.id", str(id(spark)))


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived fact computed once per (application, data dir) and written as a
    parquet table under the shared ``spark.checkpoint.dir``: lineage is cut, the
    files survive executor loss, and every report built on the fact reads only the
    columns and row groups it needs instead of recomputing the joins over the base
    tables.  A session that cannot write there gets the error, not a slower plan."""
    key = (_app_key(spark), sf_dir, name)
    if key not in _VIEWS:
        path = scratch_path(spark, f"view-{name}")
        view = build()
        view.write.parquet(path)
        with _VIEWS_LOCK:
            _VIEWS.setdefault(key, (path, view.schema))
    path, schema = _VIEWS[key]
    return spark.read.schema(schema).parquet(path)    # in the session that asks, which may be another of the application


def materialize_views(spark: SparkSession, sf_dir: str, names=("weeks", "wk", "acct", "sub")) -> None:
    """Build the independent derived facts concurrently: each is its own Spark job
    graph, so submitting them from parallel driver threads lets the scheduler fill
    executors that a single narrow job would leave idle."""
    from concurrent.futures import ThreadPoolExecutor
    ctx = Ctx(spark, sf_dir)
    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        list(pool.map(lambda n: getattr(ctx, n), names))


class Ctx:
    """Per-call access to the views; each is a materialized derived fact."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        use_query_conf(spark)
        self.t = Tables(spark, sf_dir)
        self.spark = spark
        self.sf_dir = sf_dir

    def _view(self, name, build):
        return materialized(self.spark, self.sf_dir, name, lambda: build(self.t))

    @property
    def wk(self) -> DataFrame:
        return self._view("wk", views.wk)

    @property
    def weeks(self) -> DataFrame:
        return self._view("weeks", views.week_index)

    @property
    def acct(self) -> DataFrame:
        return self._view("acct", views.acct)

    @property
    def sub(self) -> DataFrame:
        return self._view("sub", views.sub)


def _wk(fn):
    return lambda spark, d: fn(Ctx(spark, d))


def _wk_cased(fn):
    """For results in which the measure ``repeatorg`` stands beside the ratio ``repeatOrg``: another session could not write them."""
    return lambda spark, d: fn(Ctx(case_sensitive_session(spark), d))


# ------------------------------------------------------------------ weekly (family D)
query("week_index")(_wk(lambda c: c.weeks.select("week", "week_idx")))
query("weekly_measures")(_wk(lambda c: W.weekly_measures(c.wk)))
query("weekly_ratios")(_wk(lambda c: W.weekly_ratios(c.wk)))
query("paid_cac")(_wk(lambda c: W.paid_cac(c.wk)))
query("weekly_filter")(_wk_cased(lambda c: W.weekly_filter(c.wk, c.weeks, **PARAMS["weekly_filter"])))
query("week_endpoints")(_wk(lambda c: W.week_endpoints(c.wk, c.weeks)))
query("fraud_early_late")(_wk(lambda c: W.fraud_early_late(c.wk, c.weeks, **PARAMS["fraud_early_late"])))
query("wow_delta")(_wk(lambda c: W.wow_delta(c.wk, c.weeks, "region")))
query("wow_by_segment")(_wk(lambda c: W.wow_by_segment(c.wk, c.weeks, "category")))
query("weekly_dense_trend")(_wk(lambda c: W.weekly_dense_trend(c.wk, c.weeks, "region")))
query("trailing_4wk")(_wk(lambda c: W.trailing_4wk(c.wk, c.weeks, "region")))
query("trend")(_wk(lambda c: W.trend(c.wk)))
query("take_rate_split")(_wk(lambda c: W.take_rate_split(c.wk)))
query("trust_by_category")(_wk(lambda c: W.trust_by_category(c.wk)))
query("channel_cac")(_wk(lambda c: W.channel_cac(c.wk)))
query("segment_table")(_wk(lambda c: W.segment_table(c.wk, c.weeks, "category",
                                                     **PARAMS["segment_table"])))
query("movers")(_wk(lambda c: W.movers(c.wk, c.weeks, PARAMS["movers"]["watch"],
                                       PARAMS["movers"]["top"])))
query("first_last_growth")(_wk(lambda c: W.first_last_growth(c.wk, c.weeks)))
query("category_profile")(_wk(lambda c: W.category_profile(c.wk)))
query("fast_attain_corr")(_wk(lambda c: W.fast_attain_corr(c.wk)))
query("liquidity_latest")(_wk(lambda c: W.latest_kpis(
    c.wk, c.weeks, ["fundedRate", "attainment", "fastRate", "avgDonation"])))
query("paid_vs_blended_cac")(_wk(lambda c: W.paid_vs_blended_cac(c.wk, c.weeks)))
query("weekly_cube_all")(_wk_cased(lambda c: W.weekly_cube_all(c.wk)))

query("wow_cube")(_wk(lambda c: W.wow_cube(c.wk, c.weeks)))
query("trailing_cube")(_wk(lambda c: W.trailing_cube(c.wk, c.weeks)))


# ------------------------------------------------------------------ accounts (family C)
query("contract_dropna")(_wk(lambda c: A.clean(c.acct)))
query("account_filter")(_wk(lambda c: A.account_filter(c.acct, **PARAMS["account_filter"])))
query("churn_by_plan")(_wk(lambda c: A.churn_by_plan(c.acct)))
query("churn_by_plan_fixed")(_wk(lambda c: A.churn_by_plan_fixed(c.spark, c.acct,
                                                                 PARAMS["churn_by_plan_fixed"]["levels"])))
query("churn_by_dormancy")(_wk(lambda c: A.churn_by_dormancy(c.acct)))
query("dormancy_cube")(_wk(lambda c: A.dormancy_cube(c.acct)))
query("outreach_at_threshold")(_wk(lambda c: A.outreach_at_threshold(
    c.acct, PARAMS["outreach_at_threshold"]["thresholds"])))
query("outreach_grid")(_wk(lambda c: A.outreach_grid(c.spark, c.acct)))
query("account_kpis")(_wk(lambda c: A.account_kpis(c.acct)))
query("outreach_cube")(_wk(lambda c: A.outreach_cube(c.acct, **PARAMS["outreach_cube"])))
query("account_cube_all")(_wk(lambda c: A.account_cube_all(c.acct)))
query("top_risk_accounts")(_wk(lambda c: A.top_risk_accounts(c.acct, PARAMS["top_risk_accounts"]["k"])))
query("decile_capture")(_wk(lambda c: A.decile_capture(c.acct)))
query("dict_plan_by_median")(_wk(lambda c: A.dict_plan_by_median(c.acct)))
query("dict_alpha")(_wk(lambda c: A.dict_alpha(c.acct, "region")))
query("dict_preferred")(_wk(lambda c: A.dict_preferred(c.acct)))
query("cube_sample_cap")(_wk(lambda c: A.cube_sample(c.acct, **PARAMS["cube_sample_cap"])))
query("account_cube")(_wk(lambda c: A.account_cube(c.acct)))
query("report_kpi_lines")(_wk(lambda c: A.report_kpi_lines(c.acct)))
query("level_ratio")(_wk(lambda c: A.level_ratio(c.acct, **PARAMS["level_ratio"])))
query("scope_sentence")(_wk(lambda c: A.scope_sentence(c.acct, **PARAMS["account_filter"])))
query("union_all_dupes")(_wk(lambda c: A.union_all_dupes(c.acct, PARAMS["union_all_dupes"]["pct"])))
query("dedupe")(_wk(lambda c: A.dedupe(c.acct, PARAMS["union_all_dupes"]["pct"])))

# ------------------------------------------------------------------ retention (family E)
query("nrr_cohort")(_wk(lambda c: R.nrr_cohort(c.sub)))
query("retention_kpis")(_wk(lambda c: R.retention_kpis(c.sub)))
query("unit_economics")(_wk(lambda c: R.unit_economics(c.sub)))
query("retention_curve")(_wk(lambda c: R.retention_curve(c.sub)))
query("sub_region_semi")(_wk(lambda c: R.sub_region_semi(c.sub, c.wk)))
query("dict_by_sum")(_wk(lambda c: R.dict_by_sum(c.wk)))
query("weekly_cube")(_wk(lambda c: R.weekly_cube(c.wk, c.weeks)))
query("sub_cube")(_wk(lambda c: R.sub_cube(c.sub, c.wk)))
query("weekly_cube_decoded")(_wk(lambda c: R.decode_weekly_cube(R.weekly_cube(c.wk, c.weeks), c.wk, c.weeks)))
query("wk_rename")(_wk(lambda c: R.wk_rename(c.wk)))

# ------------------------------------------------------------------ profile (family A)
def _prof(fn):
    return lambda spark, d: fn(getattr(Tables(spark, d), PROFILED))


query("profile_shape")(_prof(lambda df: P.profile_shape(df, PROFILED)))
query("profile_columns")(_prof(P.profile_columns))
query("profile_distinct")(_prof(P.profile_distinct))
query("profile_numeric")(_prof(P.profile_numeric))
query("profile_top_values")(_prof(P.profile_top_values))
query("profile_likely_ids")(_prof(P.profile_likely_ids))
query("profile_likely_dates")(_prof(P.profile_likely_dates))
query("profile_target")(_prof(lambda df: P.profile_target(df, PARAMS["profile_target"]["target"])))


# the same cards over a second, differently shaped table (timestamps with microseconds,
# a measure, a JSON text column): the profiler is generic
def _prof_events(fn):
    return lambda spark, d: fn(Tables(spark, d).events)


query("profile_shape_events")(_prof_events(lambda df: P.profile_shape(df, "events")))
query("profile_columns_events")(_prof_events(P.profile_columns))
query("profile_distinct_events")(_prof_events(P.profile_distinct))
query("profile_numeric_events")(_prof_events(P.profile_numeric))
query("profile_top_values_events")(_prof_events(P.profile_top_values))
query("profile_likely_ids_events")(_prof_events(P.profile_likely_ids))
query("profile_likely_dates_events")(_prof_events(P.profile_likely_dates))
query("profile_target_events")(_prof_events(
    lambda df: P.profile_target(df, PARAMS["profile_target_events"]["target"])))


def _data_card(spark, d):
    """The whole card of three tables, one below the other."""
    from functools import reduce

    from ..operators.datacard import data_card
    use_query_conf(spark)
    cards = [data_card(getattr(Tables(spark, d), t), t, target) for t, target in PARAMS["data_card"].items()]
    return reduce(DataFrame.unionByName, cards)


query("data_card")(_data_card)


def _date_formats(spark, d):
    """Order dates as people write them: American, European with two-digit years, ambiguous ones only, mixed."""
    from ..operators.dateformats import profile_date_format
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 4
    mixed = F.when(key == 0, F.date_format(day, "yyyy-MM-dd")).when(key == 1, F.date_format(day, "MMM dd, yyyy")) \
        .when(key == 2, F.date_format(day, "dd MMMM yyyy")).otherwise(F.date_format(day, "yyyyMMdd"))
    return profile_date_format(Tables(spark, d).orders.select(
        "o_orderkey", F.date_format(day, "MM/dd/yyyy").alias("us"), F.date_format(day, "dd.MM.yy").alias("eu"),
        F.when(F.dayofmonth(day) <= 12, F.date_format(day, "dd-MM-yyyy")).alias("early"), mixed.alias("mixed"), "o_orderpriority"))


query("profile_date_format")(_date_formats)


def _dups(spark, d):
    t = Tables(spark, d)
    # whole rows of two tables, and the texts alone (whole rows of documents never repeat)
    return P.duplicate_counts(t.documents, "documents").unionByName(
        P.duplicate_counts(t.lineitem, "lineitem")).unionByName(
        P.duplicate_counts(t.documents.select("text"), "documents.text"))


query("dup_surplus")(lambda spark, d: _dups(spark, d).select("dataset", "rows", "surplus"))
query("dup_members")(lambda spark, d: _dups(spark, d).select("dataset", "rows", "members"))


LABELS_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                              T.StructField("toxic", T.IntegerType())])


def label_features(spark, d, labels_path: str | None = None):
    """Labels aligned with document features by key (J7).  Labels are an optional
    input (S4): when the file is absent the result is empty with the same schema."""
    t = Tables(spark, d)
    path = labels_path or f"{t.sf_dir}/labels.parquet"
    labels = read_optional(spark, path, LABELS_SCHEMA, fmt="parquet")
    return labels.join(t.documents.select("doc_id", "n_chars", "lang", "source"), "doc_id") \
        .select("doc_id", "quality", "toxic", "n_chars", "lang", "source")


query("label_feature_join")(label_features)

# ------------------------------------------------------------------ validity checks (family B)
query("rank_auc")(_wk(lambda c: rank_auc(c.acct, "risk", "churned").select(
    rnd("auc", 6).alias("auc"), "n_pos", "n_neg")))
query("leakage_scan")(_wk(lambda c: C.leakage_scan(c.acct, "churned")))
query("one_sided_columns")(_wk(lambda c: C.one_sided_columns(c.acct, "churned")))
query("one_sided_levels")(_wk(lambda c: C.one_sided_levels(c.acct, "churned")))
query("baselines")(_wk(lambda c: C.baselines(c.acct, "churned")))
query("validity_verdict")(_wk(lambda c: C.validity_verdict(c.acct, "churned")))
query("crosstab")(_wk(lambda c: C.crosstab(c.acct, "contract", "churned")))
query("validity_report")(_wk(lambda c: C.validity_report(c.acct, "churned")))

# ------------------------------------------------------------------ text and scalar jobs
def _tbl(name, fn):
    return lambda spark, d: fn(getattr(Tables(spark, d), name))


query("html_escape")(_tbl("documents", X.html_escape))
query("truncate_middle")(_tbl("documents", lambda df: X.truncate_middle(df, **PARAMS["truncate_middle"])))
query("collapse_ws")(_tbl("documents", X.collapse_ws))
query("json_recover")(_tbl("events", X.json_recover))
query("transcript_pack")(_tbl("conversations", X.transcript_pack))
query("transcript_last")(_tbl("conversations", lambda df: X.transcript_pack(df, **PARAMS["transcript_last"])))
query("transcript_parts")(_tbl("conversations", lambda df: X.transcript_parts(df, **PARAMS["transcript_parts"])))
query("scalar_rounding")(_tbl("orders", X.scalar_rounding))
query("format_metrics")(_wk(lambda c: X.format_metrics(c.wk)))
query("format_dates")(_wk(lambda c: X.format_dates(c.weeks)))
query("bin_right_closed")(_wk(lambda c: X.bin_right_closed(c.acct)))
query("clean_category_case")(_wk(lambda c: X.clean_category_case(views.customer_geo(c.t))))
query("one_hot_long")(_wk(lambda c: X.one_hot_long(c.acct, "id", ["plan", "region", "contract"])))
query("one_hot_dummy_na")(_wk(lambda c: X.one_hot_dummy_na(c.acct, "id", PARAMS["one_hot_dummy_na"]["levels"])))

# ------------------------------------------------------------------ sources and sinks
ACCT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("plan", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("contract", T.StringType()),
    T.StructField("mrr", T.DoubleType()), T.StructField("dorm", T.LongType()),
    T.StructField("churned", T.IntegerType()), T.StructField("risk", T.DoubleType())])


def _csv_roundtrip(spark, d):
    """CSV sink without index, then a CSV scan with an explicit schema."""
    from ..sources.files import read_csv, write_csv
    from ..sources.scratch import scratch_path
    path = scratch_path(spark, "acct-csv")
    write_csv(A.clean(Ctx(spark, d).acct), path)
    return read_csv(spark, path, ACCT_SCHEMA)


def _json_roundtrip(spark, d):
    """JSON-lines sink of the weekly measures, read back with its schema."""
    from ..sources.files import read_json, write_json
    from ..sources.scratch import scratch_path
    df = W.weekly_measures(Ctx(spark, d).wk)
    path = scratch_path(spark, "weekly-json")
    write_json(df, path)
    return read_json(spark, path, df.schema).select(*df.columns)


#: Every 13th order lacks its price (each of the missing tokens in turn), every 101st line has a field too many,
#: every 103rd a price that is no number.
MISSING = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None"]


def _untidy_csv(spark, d) -> str:
    """A CSV of the orders as files arrive: missing tokens, quoted commas, broken lines; no types are known."""
    from ..sources.scratch import scratch_path
    key = F.col("o_orderkey")
    token = F.get(F.array(*[F.lit(t) for t in MISSING]), (key % len(MISSING)).cast("int"))
    price = F.when(key % 13 == 0, token).when(key % 103 == 0, "about 5").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", key.cast("string"), price, F.date_format("o_orderdate", "yyyy-MM-dd"),
                       F.when(key % 2 == 0, "True").otherwise("false"), F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""x"""')),
                       F.when(key % 2 == 0, F.col("o_custkey").cast("string")).otherwise("1.5e3"),
                       F.when(key % 101 == 0, "a,b").otherwise("a"), F.lit("None"))
    path = scratch_path(spark, "orders-untidy")
    # one text column whose name is the header line, written without quoting
    Tables(spark, d).orders.select(line.alias("key,price,day,even,note,amount,kind,nothing")).write.option("header", True) \
        .option("sep", "\u0001").option("quote", "").option("escapeQuotes", False).option("emptyValue", "").csv(path)
    return path


def _csv_schema(spark, d):
    """Inferred types of the untidy CSV."""
    from ..sources.infer import infer_schema
    schema = infer_schema(spark, _untidy_csv(spark, d))
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)],
                                 "pos int, column string, type string")


def _csv_inferred(spark, d):
    """Typed rows of the untidy CSV, its price given as a number."""
    from ..sources.infer import read_csv_inferred
    return read_csv_inferred(spark, _untidy_csv(spark, d), {"price": T.DoubleType()})[0]


def _csv_rejects(spark, d):
    """Rejected lines of the untidy CSV with their reasons."""
    from ..sources.infer import read_csv_inferred
    return read_csv_inferred(spark, _untidy_csv(spark, d), {"price": T.DoubleType()})[1].select("reason", "record")


query("scan_csv_schema")(_csv_schema)
query("scan_csv_inferred")(_csv_inferred)
query("scan_csv_rejects")(_csv_rejects)
query("scan_csv_roundtrip")(_csv_roundtrip)
query("scan_json_roundtrip")(_json_roundtrip)



def _incremental(spark, d):
    """The weekly measures from a folder that grows: even weeks first, then the others, only new files read each time."""
    from ..sources.incremental import IncrementalSums
    from ..sources.scratch import scratch_path
    fact, folder, state = Ctx(spark, d).wk, scratch_path(spark, "grown"), scratch_path(spark, "grown-sums")
    sums = IncrementalSums(spark, folder, state, fact.schema, ["week"], W.measure_columns())
    for odd in (0, 1):
        fact.where(F.pmod(F.weekofyear("week"), F.lit(2)) == odd).write.mode("append").parquet(folder)
        sums.refresh()
    return W.project(sums.view(), ["week"], W.ALL_MEASURES)


def _published(spark, d):
    """The weekly measures read back from the latest of two copies."""
    from ..sources.publish import publish_all, read_latest
    from ..sources.scratch import scratch_path
    path, fact = scratch_path(spark, "published"), Ctx(spark, d).wk
    publish_all({"weekly": W.weekly_measures(fact.where("paid = 1"))}, path)
    publish_all({"weekly": W.weekly_measures(fact), "paid": W.paid_cac(fact)}, path)
    return read_latest(spark, path, "weekly")


def _order_profile(spark, d):
    """User code per group (U4): per order status the orders, their value in cents, the dearest, and the commonest weekday."""
    from ..operators.usercode import per_group
    days = [f"d{i}" for i in range(7)]

    def partial(rows):
        day = rows["day"].value_counts()
        return {"n": len(rows), "cents": int(rows["cents"].sum()), "most": int(rows["cents"].max()),
                **{name: int(day.get(i, 0)) for i, name in enumerate(days)}}

    def merge(states):
        return {c: int(states[c].max() if c == "most" else states[c].sum()) for c in states.columns}

    def finish(state):
        return {"n": int(state["n"]), "cents": int(state["cents"]), "most": int(state["most"]),
                "weekday": max(range(7), key=lambda i: (state[days[i]], -i))}

    orders = Tables(spark, d).orders.select(
        "o_orderstatus", (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("cents"),
        F.weekday("o_orderdate").alias("day"))
    state = ", ".join(f"{c} bigint" for c in ("n", "cents", "most", *days))
    return per_group(orders, ["o_orderstatus"], ["cents", "day"], partial, state, merge, finish,
                     "n bigint, cents bigint, most bigint, weekday int")


query("user_groups")(_order_profile)
query("weekly_incremental")(_incremental)
query("weekly_published")(_published)

# ------------------------------------------------------------------ scoring (family F)
_MODELS: dict = {}


def churn_model(spark, d):
    """One fitted model per (session, data dir): the three scoring reports share it."""
    from ..operators.scoring import ChurnModel
    key = (_app_key(spark), d)
    if key not in _MODELS:
        _MODELS[key] = ChurnModel(Ctx(spark, d).acct, "id", "churned")
    return _MODELS[key]


def _split(spark, d):
    from ..operators.scoring import stratified_split
    return stratified_split(Ctx(spark, d).acct, "id", "churned")


query("stratified_split")(_split)
query("churn_model_scores")(lambda spark, d: churn_model(spark, d).scores())
query("model_invariants")(lambda spark, d: churn_model(spark, d).invariants())
query("model_auc")(lambda spark, d: churn_model(spark, d).holdout_auc())
query("permutation_importance")(lambda spark, d: churn_model(spark, d).permutation_importance())


def oracle() -> dict[str, str]:
    from .oracle import accounts_sql, extra_sql, profile_checks_sql, retention_sql, text_sql, weekly_sql
    from .oracle_views import with_views
    out: dict[str, str] = {}
    out.update(weekly_sql(PARAMS))
    out.update(accounts_sql(PARAMS))
    out.update(retention_sql(PARAMS))
    out.update(profile_checks_sql(PARAMS))
    out.update(text_sql(PARAMS))
    out.update(extra_sql(PARAMS))
    out["model_invariants"] = with_views("acct") + (
        "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) AS n_scored, "
        "CAST(t AS BIGINT) AS n_test FROM (SELECT DISTINCT * FROM acct) "
        "JOIN (SELECT sum(t) AS t FROM (SELECT ceil(count(*) * 0.25) AS t FROM (SELECT DISTINCT * FROM acct) GROUP BY churned)) ON true "
        "GROUP BY t")
    out["scan_csv_roundtrip"] = out["contract_dropna"]
    out["scan_json_roundtrip"] = out["weekly_incremental"] = out["weekly_published"] = out["weekly_measures"]
    out["user_groups"] = (
        "WITH o AS (SELECT o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, "
        "CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day FROM orders), "
        "days AS (SELECT o_orderstatus, day, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, day) AS r "
        "FROM o GROUP BY o_orderstatus, day) "
        "SELECT o.o_orderstatus, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(cents) AS most, any_value(days.day) AS weekday "
        "FROM o JOIN days ON days.o_orderstatus = o.o_orderstatus AND r = 1 GROUP BY o.o_orderstatus")
    out["stratified_split"] = with_views("acct") + (
        "SELECT id, churned, CASE WHEN row_number() OVER (PARTITION BY churned ORDER BY h, id) - 1 < "
        "ceil(count(*) OVER (PARTITION BY churned) * 0.25) THEN 'test' ELSE 'train' END AS split FROM ("
        "SELECT id, churned, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15))::BIGINT AS h FROM acct)")
    return out
