"""The card and the validity gate on tables that do not look like the driver tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.numeric import rnd
from bizlens.operators import accounts as A
from bizlens.operators import checks as C
from bizlens.operators import profile as P
from bizlens.sources.files import read_csv

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def leaky(spark):
    """A boolean and a two-level date that give the target away but for one row in forty."""
    rows = [(i, i % 4 == 0 and i % 40 != 0, DAY if i % 4 == 0 and i % 40 != 0 else DAY + dt.timedelta(1), float(i % 7), int(i % 4 == 0))
            for i in range(400)]
    return spark.createDataFrame(rows, "id long, seen boolean, day date, noise double, y int")


def test_boolean_and_date_leaks_are_found(leaky):
    scan = {r["column"]: r for r in C.leakage_scan(leaky, "y").collect()}
    assert scan["seen"].flagged and scan["day"].flagged and not scan["noise"].flagged
    assert C.validity_verdict(leaky, "y").first()["verdict"] == "review_required"


NUMBERS, TEXTS, OTHERS = "a long, y int", "a string, y string", "a boolean, b date, y int"


@pytest.mark.parametrize("schema, row", [(NUMBERS, (1, 0)), (TEXTS, ("x", "0")), (OTHERS, (True, DAY, 1))])
def test_cards_of_one_kind_of_column(spark, schema, row):
    for df in (spark.createDataFrame([row] * 3, schema), spark.createDataFrame([], schema)):
        for card in (P.profile_numeric, P.profile_top_values, P.profile_likely_dates, P.profile_distinct, P.profile_likely_ids):
            card(df).collect()
    assert P.profile_top_values(spark.createDataFrame([row], NUMBERS) if schema == NUMBERS else df).count() == 0


def test_gate_without_eligible_columns(spark):
    wide = spark.range(60).selectExpr("concat('v', id) AS a", "CAST(id % 2 AS INT) AS y")
    assert C.leakage_scan(wide, "y").count() == 0 and C.one_sided_columns(wide, "y").count() == 0
    assert C.validity_verdict(wide, "y").first()["verdict"] == "clean"
    assert C.validity_report(wide, "y").count() > 0


def test_three_classes(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("c", 2)], "k string, y int")
    assert [r.one_sided for r in C.one_sided_columns(df, "y").collect()] == [False]
    assert {(r["value"], r["class"], r["n"]) for r in C.crosstab(df, "k", "y").collect()} == {("a", "0", 1), ("b", "1", 1), ("c", "2", 2)}


def test_ties_go_to_the_even_digit(spark):
    got = spark.range(1).select(rnd(F.lit(0.0625), 3), rnd(F.lit(0.1875), 3), rnd(F.lit(-0.0625), 3), rnd(F.lit(2.5), 0)).first()
    assert tuple(got) == (0.062, 0.188, -0.062, 2.0)


def test_equal_values_have_one_text(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert P.profile_distinct(df).first()["n_unique"] == 2


def test_csv_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x,s\n1,2.5,a\nNA,NaN,null\n,None,\n3,4,N/A\n")
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])
    rows = [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), schema).collect()]
    assert rows == [(1, 2.5, "a"), (None, None, None), (None, None, None), (3, 4.0, None)]
    (tmp_path / "b.csv").write_text("n\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, str(tmp_path / "b.csv"), T.StructType([T.StructField("n", T.LongType())])).collect()


def test_dates_in_other_formats(spark):
    df = spark.createDataFrame([("12/25/2024", "25.12.2024", "2024-12-25", "x")] * 3, "a string, b string, c string, d string")
    assert {r["column"]: r["likely_date"] for r in P.profile_likely_dates(df).collect()} == {"a": True, "b": True, "c": True, "d": False}


def test_cube_has_every_account(spark):
    n = 60_000
    acct = spark.range(n).selectExpr("id", "concat('p', id % 3) AS plan", "concat('r', id % 5) AS region", "'annual' AS contract",
                                     "CAST(id % 100 AS DOUBLE) AS mrr", "id % 20000 AS dorm", "CAST(id % 2 AS INT) AS churned",
                                     "0.5D AS risk")
    cube = A.account_cube(acct.union(acct.limit(3)))
    assert cube.count() == n + 3 and cube.agg(F.max("ordinal"), F.count_distinct("ordinal")).first() == (n + 2, n + 3)
    assert A.churn_by_dormancy(acct).agg(F.sum("n")).first()[0] == n
