"""User code per group against native aggregates, with a group of a third of the rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.operators import usercode


def slope(df, keys):
    """Least squares of y on x, from sums."""
    def partial(rows):
        x, y = rows["x`1"].astype(float), rows["y.z"].astype(float)
        return {"n": len(rows), "sx": x.sum(), "sy": y.sum(), "sxx": (x * x).sum(), "sxy": (x * y).sum()}

    def finish(s):
        spread = s["n"] * s["sxx"] - s["sx"] ** 2
        return {"n": int(s["n"]), "slope": (s["n"] * s["sxy"] - s["sx"] * s["sy"]) / spread if spread else None}

    return usercode.per_group(df, keys, ["x`1", "y.z"], partial, "n bigint, sx double, sy double, sxx double, sxy double",
                              lambda states: states.sum().to_dict(), finish, "n bigint, slope double")


@pytest.mark.parametrize("held", [3, 10_000])
def test_a_hot_group_equals_the_native_aggregate(spark, monkeypatch, held):
    monkeypatch.setattr(usercode, "HELD", held)
    df = spark.range(0, 6000, numPartitions=11).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 40).cast("bigint").alias("a.k"),
        (F.col("id") % 17).alias("x`1"), (F.col("id") * 7 % 23).alias("y.z"), F.lit("own").alias("_key"))
    got = {r[0]: (r[1], r[2]) for r in slope(df, ["a.k"]).collect()}
    native = df.groupBy("`a.k`").agg(F.count(F.lit(1)), F.regr_slope("`y.z`", "`x``1`")).collect()
    assert set(got) == {r[0] for r in native} and got[-1][0] >= 2000
    for r in native:
        assert got[r[0]][0] == r[1] and got[r[0]][1] == pytest.approx(r[2])


def test_no_row_of_a_hot_group_reaches_the_last_task(spark):
    df = spark.range(0, 4000, numPartitions=8).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    most = usercode.per_group(df, ["k"], ["v"], lambda r: {"n": len(r), "states": 1}, "n bigint, states bigint",
                              lambda s: {"n": s["n"].sum(), "states": len(s)}, lambda s: s, "n bigint, states bigint").first()
    assert most["n"] == 4000 and most["states"] <= usercode.SALT


def test_keys_of_all_kinds_come_back(spark):
    rows = [(2**60 + 1, "a\"é", dt.datetime(2024, 1, 2, 3, 4, 5, 678901), 0.1, dt.date(2024, 2, 29)), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, i) for i in range(3) for r in rows], "a bigint, b string, c timestamp, d double, e date, v int")
    keys = ["a", "b", "c", "d", "e"]
    got = usercode.per_group(df, keys, ["v"], lambda r: {"s": r["v"].sum()}, "s bigint", lambda s: {"s": s["s"].sum()},
                             lambda s: {"s": s["s"]}, "s bigint")
    assert got.dtypes[:5] == df.dtypes[:5]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(*r, 3) for r in rows], key=repr)
    assert got.where("false").count() == 0
    empty = usercode.per_group(df.where("false"), keys, ["v"], lambda r: {"s": 0}, "s bigint", lambda s: {"s": 0}, lambda s: s, "s bigint")
    assert empty.collect() == [] and empty.columns == [*keys, "s"]
    assert np.isfinite(got.agg(F.sum("s")).first()[0])
