"""Any column name in the card and the gate, the one-scan data card, the date-format vote, CSV inference with rejects."""

import csv
import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.operators import checks as C
from bizlens.operators import profile as P
from bizlens.operators.datacard import data_card
from bizlens.operators.dateformats import profile_date_format, readings
from bizlens.sources import infer

NAMES = ["a.b", "tick`s", "with blank", "n", "N", "value", "column", "_c0", "pos", "y.z"]


@pytest.fixture(scope="module")
def named(spark):
    """Dots, back-ticks, blanks, two names that differ by case, names of results and inner names; the last is the target."""
    rows = [(i, f"t{i % 3}", float(i % 5), i % 2, -i, "same", f"v{i}", i % 7, "2024-01-01", int(i % 4 == 0)) for i in range(40)]
    return spark.createDataFrame(rows + rows[:3], T.StructType([
        T.StructField(n, t()) for n, t in zip(NAMES, (T.LongType, T.StringType, T.DoubleType, T.LongType, T.LongType, T.StringType,
                                                      T.StringType, T.LongType, T.StringType, T.IntegerType))]))


def test_cards_take_any_column_name(named):
    assert [r["column"] for r in P.profile_columns(named).orderBy("pos").collect()] == NAMES
    assert {r["column"]: r["n_unique"] for r in P.profile_distinct(named).collect()} \
        == dict(zip(NAMES, (40, 3, 5, 2, 40, 1, 40, 7, 1, 2)))
    assert {r["column"] for r in P.profile_distinct(named, approx=True).collect()} == set(NAMES)
    assert {r["column"] for r in P.profile_numeric(named).collect()} == {"a.b", "with blank", "n", "N", "_c0", "y.z"}
    assert {r["column"] for r in P.profile_top_values(named).collect()} == {"tick`s", "value", "column", "pos"}
    assert P.profile_likely_ids(named).collect() == []
    assert [r["column"] for r in P.profile_likely_dates(named).where("likely_date").collect()] == ["pos"]
    assert P.profile_target(named, "tick`s").count() == 3 and P.profile_target(named, "N").first()["is_binary"] is False
    d = P.duplicate_counts(named, "x").first()
    assert (d["rows"], d["surplus"], d["members"]) == (43, 3, 6)
    assert P.duplicate_counts(named, "x", ["tick`s", "n"]).first()["members"] == 43


def test_gate_takes_any_column_name(named):
    scan = {r["column"]: r["univariate_auc"] for r in C.leakage_scan(named, "y.z").collect()}
    assert set(scan) == set(NAMES) - {"column", "y.z"}      # a text column of 40 levels is not scored
    assert C.validity_verdict(named, "y.z").first()["duplicate_rows"] == 6
    assert {r["column"] for r in C.one_sided_columns(named, "y.z").collect()} >= {"tick`s", "with blank", "pos"}
    assert C.validity_report(named, "y.z").count() >= 3 and C.crosstab(named, "tick`s", "y.z").count() == 6
    assert C.baselines(named, "y.z").first()["majority_class_accuracy"] > 0.7


def test_digest_collisions_are_not_duplicates(spark, monkeypatch):
    monkeypatch.setattr(P, "row_digest", lambda df: [F.lit(1).cast("bigint").alias("_h1"), F.lit(1).cast("bigint").alias("_h2")])
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 1)], "a int, b int")
    assert [r["n"] for r in P.duplicate_rows(df).collect()] == [2]
    import bizlens.operators.datacard as D
    monkeypatch.setattr(D, "row_digest", P.row_digest)
    got = {r["key"]: r["n"] for r in D.data_card(df, "t").where("section = 'duplicates'").collect()}
    assert got == {"surplus": 1, "members": 2}


def test_data_card_agrees_with_the_single_cards(spark, named):
    card = data_card(named, "named", "tick`s").collect()
    at = lambda section: {(r["column"], r["key"]): r["n"] if r["x"] is None else r["x"] for r in card if r["section"] == section}
    assert at("shape") == {(None, "rows"): 43, (None, "columns"): len(NAMES)}
    assert at("distinct") == {(r["column"], None): r["n_unique"] for r in P.profile_distinct(named).collect()}
    assert at("top values") == {(r["column"], r["value"]): r["count"] for r in P.profile_top_values(named).collect()}
    assert at("numeric") == {(r["column"], k): r[k] for r in P.profile_numeric(named).collect()
                             for k in ("min", "p25", "median", "p75", "max", "mean")}
    assert at("target") == {("tick`s", r["value"]): r["share"] for r in P.profile_target(named, "tick`s").collect()}
    assert at("duplicates") == {(None, "surplus"): 3, (None, "members"): 6}


def test_data_card_of_nothing(spark):
    df = spark.createDataFrame([], "a long, b string, c date")
    got = {(r["section"], r["column"], r["key"]): r["n"] for r in data_card(df, "t", "b").collect()}
    assert got["shape", None, "rows"] == 0 and got["distinct", "a", None] == 0 and got["duplicates", None, "surplus"] == 0
    nulls = spark.createDataFrame([(None, None)] * 2, "a double, b string")
    got = {(r["section"], r["column"], r["key"]): r["x"] if r["n"] is None else r["n"] for r in data_card(nulls, "t", "b").collect()}
    assert got["target", "b", None] == 1.0 and got["duplicates", None, "members"] == 2


# ---- date formats

@pytest.mark.parametrize("text, want", [
    ("2024-02-29", ("year-month-day", True, True)), ("2023-02-29", None), ("2024-05-01T10:00:00Z", ("year-month-day", True, True)),
    ("20240229", ("yearmonthday", True, True)), ("20241301", None), ("12345678901", None), ("1/2/2024", ("n/n/year", True, True)),
    ("13/2/24", ("n/n/year", True, False)), ("2/13/24", ("n/n/year", False, True)), ("31.4.2024", None), ("30.4.24", ("n.n.year", True, False)),
    ("29.2.00", ("n.n.year", True, False)), ("29.2.01", None), ("3 March 2024", ("day name year", True, True)),
    ("03-Mar-24", ("day name year", True, True)), ("MAY 5, 2024", ("name day year", True, True)), ("Sept 5, 2024", None),
    ("Feb 30, 2024", None), (" 2024-01-01 ", ("year-month-day", True, True)), ("", None), ("abc", None), (None, None)])
def test_date_readings(spark, text, want):
    r = spark.createDataFrame([(text,)], "v string").select(readings(F.col("v")).alias("r")).first()["r"]
    assert (None if r is None else tuple(r)) == want


def test_date_format_vote(spark):
    rows = [("01/02/2024", "01/02/2024", "x")] * 5 + [("13/02/2024", "02/13/2024", None)] + [("02/14/2024", "5 May 2024", "2024-13-01")]
    got = {(r["column"], r["format"]): r for r in profile_date_format(spark.createDataFrame(rows, "`a.b` string, us string, no string")).collect()}
    assert set(got) == {("a.b", "n/n/year"), ("us", "n/n/year"), ("us", "day name year")}
    tie, us = got["a.b", "n/n/year"], got["us", "n/n/year"]
    assert (tie["order"], tie["n"], tie["decisive"]) == ("month first", 6, 1)          # one vote each: the default
    assert (us["order"], us["n"], us["decisive"], us["chosen"], us["share"]) == ("month first", 6, 1, True, 0.8571)
    assert profile_date_format(spark.createDataFrame([], "a string")).collect() == []
    assert profile_date_format(spark.createDataFrame([(1,)], "a int")).collect() == []


# ---- CSV inference

def plain_class(v):
    """The class of a cell in plain Python."""
    if v is None or v.strip() in infer.MISSING_TOKENS:
        return None
    v = v.strip()
    if re.fullmatch(r"[+-]?\d{1,19}", v) and -2 ** 63 <= int(v) < 2 ** 63:
        return "whole"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
        return "number"
    if v.lower() in ("true", "false"):
        return "boolean"
    for form, name in (("%Y-%m-%d", "date"), ("%Y-%m-%d %H:%M", "instant"), ("%Y-%m-%d %H:%M:%S", "instant")):
        if re.fullmatch(r"\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d)?)?", v):
            try:
                dt.datetime.strptime(v.replace("T", " "), form)
                return name
            except ValueError:
                pass
    return "text"


def test_inferred_types_equal_a_plain_pass(spark, tmp_path):
    rng = random.Random(4)
    pools = [["1", "-7", "+3", "NA", ""], ["1", "2.5", ".5", "1e3", "nan", "None"], ["true", "False", "null"], ["2024-01-31", "N/A"],
             ["2024-01-31", "2024-01-31 10:00", "2024-02-01T10:00:01"], ["1", "true"], ["2024-02-30", "2024-01-01"],
             ["99999999999999999999", "1"], ["", "NULL"], [" 4 ", "5"], ["é,x", 'say "hi"', "a"]]
    names = [f"col {i}.x" for i in range(len(pools))]
    rows = [[rng.choice(p) for p in pools] for _ in range(60)] + [[p[i % len(p)] for p in pools] for i in range(6)]
    with open(tmp_path / "t.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(names)
        w.writerows(rows)
    got = infer.infer_schema(spark, str(tmp_path))
    want = [infer.join_classes({c for r in rows if (c := plain_class(r[i])) is not None}) for i in range(len(pools))]
    assert [(f.name, f.dataType) for f in got.fields] == [(n, infer._TYPES[c]) for n, c in zip(names, want)]
    good, bad = infer.read_csv_inferred(spark, str(tmp_path))
    assert bad.count() == 0 and good.count() == len(rows)
    back = [tuple(r) for r in good.select(F.col(f"`{names[0]}`"), F.col(f"`{names[10]}`"), F.col(f"`{names[8]}`")).collect()]
    assert sorted(back, key=str) == sorted(((None if r[0] in ("NA", "") else int(r[0]), r[10], None) for r in rows), key=str)


def test_rejects_have_exact_lines_in_any_split(spark, tmp_path):
    want = set()
    for name, n in (("a.csv", 3_000), ("b.csv", 500)):
        with open(tmp_path / name, "w", encoding="utf-8") as f:
            f.write("id,amount,note\n")
            for line in range(2, n + 2):
                if line % 97 == 0:
                    f.write(f"{line},1,x,too many\n")
                    want.add((name, line, "fields"))
                elif line % 89 == 0:
                    f.write(f"{line},much,x\n")
                    want.add((name, line, "type: amount"))
                elif line % 83 == 0:
                    f.write("\n")
                elif line % 79 == 0:
                    f.write(f"{line}\n")
                    want.add((name, line, "fields"))
                else:
                    f.write(f"{line},{line / 4},{'word ' * (line % 9)}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        good, bad = infer.read_csv_inferred(spark, str(tmp_path), {"amount": T.DoubleType()})
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert {(os.path.basename(r["file"]), r["line"], r["reason"]) for r in bad.collect()} == want
        assert [f.dataType.simpleString() for f in good.schema.fields] == ["bigint", "double", "string"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_inference_of_nothing(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert infer.infer_schema(spark, str(tmp_path)).fields == []
    (tmp_path / "e.csv").write_text("a,,c\n")
    good, bad = infer.read_csv_inferred(spark, str(tmp_path))
    assert good.columns == ["a", "_1", "c"] and good.count() == 0 and bad.count() == 0
