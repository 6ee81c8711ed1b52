"""The paths that only matter at scale, forced onto small inputs and checked
against brute force: the sketch-screened level count, range buckets over many
groups (and with the bucket budget exhausted), the bounded one-hot dictionary."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bizlens.operators import ranking
from bizlens.operators.checks import low_cardinality
from bizlens.operators.ranking import prefix_sums
from bizlens.operators.textjobs import one_hot_dummy_na, one_hot_long


def test_low_cardinality_exact_at_the_limit(spark):
    rows = [(f"a{i % 30}", f"b{i % 31}", f"c{i}", None, float(i % 3) if i % 5 else float("nan"))
            for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e double")
    got = low_cardinality(df, ["a", "b", "c", "d", "e"], 30)
    # a: 30 levels, b: 31, c: 600, d: all missing (0 levels), e: 3 levels (NaN is missing)
    assert got == {"a", "d", "e"}
    assert low_cardinality(df, ["a", "b"], 31) == {"a", "b"}
    assert low_cardinality(df, [], 30) == set()


def test_low_cardinality_levels_sorted_and_bounded(spark):
    from bizlens.operators.checks import low_cardinality_levels
    df = spark.createDataFrame([("b", "x1"), ("a", "x2"), (None, "x3"), ("b", "x4"), ("\u00e9", "x5")],
                               "t string, u string")
    got = low_cardinality_levels(df, ["t", "u"], 3)
    assert got == {"t": ["a", "b", "\u00e9"]}


@pytest.mark.parametrize("limit", [20, 200])
def test_low_cardinality_screen_keeps_every_small_column(spark, limit):
    """The sketch screen never drops a column that has exactly ``limit`` values."""
    rows = [(f"x{i % limit}", i % (limit + 1)) for i in range(5 * limit)]
    df = spark.createDataFrame(rows, "a string, b long")
    assert low_cardinality(df, ["a", "b"], limit) == {"a"}


def _brute_below(rows):
    out = {}
    for g, v, w in rows:
        out[(g, v)] = sum(ww for gg, vv, ww in rows if gg == g and vv < v)
    return out


@pytest.mark.parametrize("max_buckets", [4096, 3])
def test_prefix_sums_many_groups(spark, monkeypatch, max_buckets):
    monkeypatch.setattr(ranking, "MAX_BUCKETS", max_buckets)
    rnd = random.Random(11)
    rows = []
    for gi, g in enumerate(["g0", "g1", "g2", "g3", None]):
        n = [1, 5, 17, 40, 23][gi]
        for v in rnd.sample(range(1000), n):
            rows.append((g, v, rnd.randint(1, 9)))
    df = spark.createDataFrame(rows, "g string, v long, w long")
    got = {(r["g"], r["v"]): r["w_below"]
           for r in prefix_sums(df, "v", ["w"], ["g"], rows_per_bucket=3).collect()}
    assert got == _brute_below(rows)


def test_bucket_bounds_one_job_per_call(spark):
    """Bounds of all oversized groups come from one aggregate, whatever their number."""
    rows = [(g, v) for g in range(12) for v in range(50)]
    df = spark.createDataFrame(rows, "g long, v long")
    sc = spark.sparkContext
    before = sc.statusTracker().getJobIdsForGroup(None)
    b = ranking.bucket_column(df, "v", ["g"], rows_per_bucket=10)
    jobs = set(sc.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert b is not None
    # group sizes + bounds (each may be split in a few jobs by AQE), never one per group
    assert len(jobs) < 12
    got = {r["g"]: r["nb"] for r in df.select("g", b.alias("b")).groupBy("g")
           .agg({"b": "max"}).withColumnRenamed("max(b)", "nb").collect()}
    assert all(nb == math.ceil(50 / 10) - 1 for nb in got.values())


def test_one_hot_of_any_number_of_levels(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id < 2999 THEN concat('v', id) END AS c")
    long = one_hot_long(df, "id", ["c"])
    assert long.count() == 3000 and long.where("level IS NULL").count() == 1
    assert one_hot_dummy_na(df, "id", {"c": ["v1", "v2"]}).columns == ["id", "c_v1", "c_v2", "c_nan"]



def test_bounded_broadcast_checks_the_size(spark):
    from bizlens.operators.joins import bounded_broadcast
    conf = "spark.sql.autoBroadcastJoinThreshold"
    saved = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        big = spark.range(2000).withColumn("k", F.col("id") % 50)
        small = spark.range(50).withColumnRenamed("id", "k").withColumn("label", F.col("k") * 10)
        for limit, expect_broadcast in ((50, True), (49, False)):
            j = big.join(bounded_broadcast(small, limit), "k")
            plan = j._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == expect_broadcast
            assert j.count() == 2000
    finally:
        spark.conf.set(conf, saved)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_cell_medians_by_selection_equal_a_sort(spark, buckets):
    import random
    from bizlens.operators.accounts import cell_upper_medians
    rng = random.Random(buckets)
    rows = [(rng.choice("ab"), rng.choice(["x", None]), rng.choice([1.5, 2.5, rng.random() * 9])) for _ in range(500)] + [("c", "x", None)]
    got = cell_upper_medians(spark.createDataFrame(rows, "p string, q string, v double"), "v", ["p", "q"], buckets).collect()
    cells = {}
    for p, q, v in rows:
        if v is not None:
            for gid in range(4):
                cells.setdefault((gid, None if gid & 2 else p, None if gid & 1 else q), []).append(v)
    assert {tuple(r)[:3]: r["median"] for r in got} == {k: sorted(v)[len(v) // 2] for k, v in cells.items()} and len(got) == len(cells)
    empty = spark.createDataFrame([], "p string, q string, v double")
    assert cell_upper_medians(empty, "v", ["p", "q"], buckets).collect() == []


def test_outreach_cube_with_all_filters_off_is_the_grid(spark):
    from bizlens.operators import accounts as A
    from bizlens.plans.queries import Ctx
    from tests.conftest import SF_SMALL
    acct = Ctx(spark, SF_SMALL).acct
    cube = A.outreach_cube(acct).where("gid = 7").drop("gid", "plan", "region", "contract")
    grid = A.outreach_grid(spark, acct)
    assert sorted(map(tuple, cube.collect())) == sorted(map(tuple, grid.collect())) and cube.columns == grid.columns
    assert A.outreach_cube(acct.limit(0)).collect() == []
