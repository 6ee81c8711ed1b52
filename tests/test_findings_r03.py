"""Findings of the third round, on rows of the tests' own."""

import datetime as dt
import itertools
import os

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from bizlens.plans.queries import REGISTRY as QUERIES
from tests.compare import TABLES, compare


def _orders(n=240):
    """Keys that repeat or are null, customers twice or unknown, dates missing, equal dates of one customer."""
    out = []
    for i in range(n):
        day = dt.datetime(2020, 1, 1) + dt.timedelta(days=(i * 37) % 400)
        out.append((None if i % 29 == 0 else i // 2 if i % 5 == 0 else i, None if i % 31 == 0 else (i * 7) % 12, "FOP"[i % 3],
                    100.0 + i, None if i % 41 == 0 else day, ["1-URGENT", "5-LOW", None][i % 3]))
    return out + [out[3], out[50]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("own"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}")
        part = next(f for f in os.listdir(f"{d}/{name}") if f.endswith(".parquet"))
        os.link(f"{d}/{name}/{part}", f"{d}/{name}.parquet")

    put("region", [(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string")
    put("nation", [(k, f"n{k}", k % 2) for k in range(4)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(k, k % 4, ["BUILDING", "HOUSEHOLD", None][k % 3]) for k in range(11)] + [(3, 2, "MACHINERY"), (4, 0, "HOUSEHOLD")],
        "c_custkey long, c_nationkey int, c_mktsegment string")
    put("orders", _orders(), "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string")
    lines = [(None if i % 53 == 0 else (i * 11) % 200, 10.5 + i, (i % 11) / 100, (i % 9) / 100, "RNA"[i % 3],
              None if i % 47 == 0 else dt.datetime(2020, 1, 1) + dt.timedelta(days=(i * 13) % 430)) for i in range(700)]
    put("lineitem", lines, "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_shipdate timestamp_ntz")
    return d


def _duck(d):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["weekly_cube_all", "weekly_filter"])
def test_results_whose_names_differ_in_case_can_be_written(spark, tables, tmp_path, name):
    df = QUERIES[name](spark, tables)
    df.write.parquet(str(tmp_path / "r"))
    written = ds.dataset(str(tmp_path / "r")).to_table()
    assert written.column_names == df.columns and {"repeatorg", "repeatOrg"} <= set(df.columns)
    assert written.num_rows == df.count() > 0
    assert spark.conf.get("spark.sql.caseSensitive") == "false"      # the session given is left as it is


def test_weekly_fact_of_repeated_and_missing_keys(spark, tables):
    from bizlens.plans import views
    from bizlens.plans.oracle_views import with_views
    from bizlens.sources.tables import Tables
    ok, msg = compare(views.wk(Tables(spark, tables)), _duck(tables), with_views("wk") + "SELECT * FROM wk", 12)
    assert ok, msg


def test_sums_of_lines_are_moved_by_cell_alone(spark, tables):
    """Bytes shuffled: an order's line sums stay where they are made (they went through three shuffles)."""
    from bizlens.plans import views
    from bizlens.sources.tables import Tables
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    saved = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = views.wk(Tables(spark, tables))
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    moved = [b for b in plan.split("\n\n") if " Exchange\n" in b]
    assert moved and not [b for b in moved if "l_gdv" in b or "l_tips" in b], moved


def test_data_card_tries_values_as_dates_once(spark, monkeypatch):
    """Seconds: five sections read the shares of dates, and each tried every distinct text again."""
    import bizlens.operators.datacard as D
    monkeypatch.setattr(D, "readable", lambda c: F.length(c) == 987654)
    df = spark.createDataFrame([(1, "2020-01-02"), (2, "x"), (2, "x"), (3, None)], "a int, b string")
    card = D.data_card(df, "t", "b")
    assert "987654" not in spark.sparkContext._jvm.PythonSQLUtils.explainString(card._jdf.queryExecution(), "extended")
    got = {(r["section"], r["column"], r["key"]): (r["n"], r["x"]) for r in card.collect()}
    assert got["shape", None, "rows"] == (4, None) and got["likely date", "b", "false"] == (None, 0.3333)
    assert got["columns", "b", "string"] == (1, 25.0) and got["duplicates", None, "members"] == (2, None)


def test_training_and_scoring_take_time_by_different_rows(spark, monkeypatch):
    """Seconds: 40 copies of the accounts train on the weighted rows of one and score each different row once."""
    from bizlens.operators import scoring
    from bizlens.operators.scoring import ChurnModel
    monkeypatch.setattr(scoring, "GBT_PARAMS", {**scoring.GBT_PARAMS, "maxIter": 3})
    seen = []
    fit, transformed = scoring.build_pipeline, ChurnModel._transformed

    def pipeline(*args):
        p = fit(*args)
        inner = p.fit
        p.fit = lambda df: (seen.append(("fit", df.count(), df.agg(F.sum("_n")).first()[0])), inner(df))[1]
        return p

    monkeypatch.setattr(scoring, "build_pipeline", pipeline)
    monkeypatch.setattr(ChurnModel, "_transformed", lambda self, x: (seen.append(("score", x.count())), transformed(self, x))[1])
    rows = spark.range(4000).selectExpr(
        "id", "CASE WHEN id % 100 % 9 = 0 THEN NULL ELSE CAST(id % 100 AS DOUBLE) END AS x", "concat('p', id % 100 % 3) AS plan",
        "CAST(id % 100 % 4 = 0 AS INT) AS churned")
    model = ChurnModel(rows)
    assert model.holdout_auc().first()["n_pos"] == 250
    model.permutation_importance(repeats=2).collect()
    (_, n, weight), *scored = seen
    assert n <= 200 and weight == 3000                       # classes x bins x levels, all training rows counted
    assert max(s[1] for s in scored) <= 33 * 3               # bins and missing x levels
    assert model.scores().count() == 4000


def test_bin_ends_are_the_learners_own(spark, monkeypatch):
    from bizlens.operators import scoring
    few = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 4)], "v double")
    assert scoring.bin_ends(few, "v") == [1.5, 3.0]
    many = spark.range(6400).selectExpr("CAST(id % 640 AS DOUBLE) AS v")
    ends = scoring.bin_ends(many, "v")
    assert ends == [20.0 * k - 0.5 for k in range(1, 32)]
    monkeypatch.setattr(scoring, "CUT_POINTS", 320)
    assert all(abs(a - b) <= 4 for a, b in itertools.zip_longest(scoring.bin_ends(many, "v"), ends, fillvalue=1e9))
