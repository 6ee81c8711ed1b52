"""Copies that are never half there, and sums that read new files only."""

import os

import pytest
from pyspark.sql import functions as F

from bizlens.sources import incremental, publish
from bizlens.sources.incremental import IncrementalSums
from bizlens.sources.scratch import scratch_path


def numbers(df):
    return sorted(r[0] for r in df.select("n").collect())


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_latest_copy(spark, fmt):
    path = scratch_path(spark, "pub")
    with pytest.raises(publish.NothingPublished):
        publish.read_latest(spark, path)
    df = spark.range(5).select(F.col("id").alias("n"), F.col("id").cast("string").alias("s"))
    assert publish.publish(df, path, fmt) == 1 and numbers(publish.read_latest(spark, path)) == [0, 1, 2, 3, 4]
    assert publish.publish(df.where("n > 2"), path + "/", fmt) == 2
    got = publish.read_latest(spark, path)
    assert numbers(got) == [3, 4] and got.dtypes == df.dtypes
    publish.publish(df.where("false"), path, fmt)
    assert publish.read_latest(spark, path).dtypes == df.dtypes and numbers(publish.read_latest(spark, path)) == []


def test_writer_killed_half_way_leaves_the_old_copy(spark):
    path = scratch_path(spark, "pub")
    publish.publish_all({"a": spark.range(3).toDF("n"), "b": spark.range(4).toDF("n")}, path)
    broken = spark.range(8, numPartitions=4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("killed")).cast("bigint"))
                                                    .otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="killed"):
        publish.publish_all({"a": spark.range(9).toDF("n"), "b": broken}, path)
    # the new copy of "a" is written in full, but no reader sees it beside the old "b"
    assert numbers(publish.read_latest(spark, path, "a")) == [0, 1, 2] and publish.read_latest(spark, path, "b").count() == 4
    assert publish.publish_all({"a": spark.range(1).toDF("n")}, path) == 2
    assert numbers(publish.read_latest(spark, path, "a")) == [0]


def test_readers_of_the_copy_before_finish_and_older_ones_go(spark):
    path = scratch_path(spark, "pub")
    publish.publish(spark.range(1).toDF("n"), path)
    before = publish.read_latest(spark, path)
    publish.publish(spark.range(2).toDF("n"), path)
    assert before.count() == 1
    publish.publish(spark.range(3).toDF("n"), path)
    assert publish.commits(spark, path) == [2, 3]
    local = path.removeprefix("file:")
    assert len([f for f in os.listdir(local) if f.startswith("copy-")]) == 2


def test_a_commit_that_follows_another_is_refused(spark):
    path = scratch_path(spark, "pub")
    publish.publish(spark.range(1).toDF("n"), path, expected=0)
    with pytest.raises(publish.Conflict):
        publish.publish(spark.range(2).toDF("n"), path, expected=0)
    assert numbers(publish.read_latest(spark, path)) == [0]
    publish.publish(spark.range(2).toDF("n"), path, expected=1)
    assert len(numbers(publish.read_latest(spark, path))) == 2


def fact(spark, rows):
    return spark.createDataFrame(rows, "week int, region string, n int, money int") \
        .withColumn("money", F.col("money").cast("decimal(18,2)") / 4).withColumn("money", F.col("money").cast("decimal(18,2)")).coalesce(1)


def sums(spark, folder, state):
    return IncrementalSums(spark, folder, state, fact(spark, []).schema, ["week", "region"],
                           {"n": F.col("n"), "money": F.col("money"), "twice": F.col("n") * 2})


def full(spark, folder):
    return sorted(map(tuple, spark.read.schema(fact(spark, []).schema).parquet(folder).groupBy("week", "region")
                      .agg(F.sum("n"), F.sum("money"), F.sum(F.col("n") * 2)).collect()), key=repr)


@pytest.mark.parametrize("merge", [1, 16])
def test_only_new_files_are_read_and_the_view_equals_a_full_run(spark, monkeypatch, merge):
    monkeypatch.setattr(incremental, "MERGE", merge)
    folder, state = scratch_path(spark, "facts with blank"), scratch_path(spark, "state")
    s = sums(spark, folder, state)
    read = []
    whole = IncrementalSums._sums
    monkeypatch.setattr(IncrementalSums, "_sums", lambda self, files: read.append(len(files)) or whole(self, files))

    def check(**expected):
        assert s.refresh() == expected
        assert sorted(map(tuple, s.view().collect()), key=repr) == full(spark, folder)

    hot = [(1, "a", i % 7, i) for i in range(500)]
    fact(spark, [*hot, (1, None, 5, 1), (None, "b", None, None)]).write.parquet(folder)
    check(read=1, forgotten=0, left=0)
    check(read=0, forgotten=0, left=1)
    fact(spark, [(1, "a", 9, 9), (2, "a", 1, 1)]).write.mode("append").parquet(folder)
    fact(spark, [(2, "a", 1, 1)]).write.mode("append").parquet(folder)
    check(read=2, forgotten=0, left=1)
    local = folder.removeprefix("file:")
    parts = sorted((f for f in os.listdir(local) if f.endswith(".parquet")), key=lambda f: os.path.getsize(f"{local}/{f}"))
    os.utime(f"{local}/{parts[0]}", (1, 1))                              # as if written anew
    check(read=1, forgotten=1, left=2)
    os.remove(f"{local}/{parts[-1]}")
    check(read=0, forgotten=1, left=2)
    assert read == [1, 2, 1]


def test_empty_folder_and_two_refreshes_at_once(spark, monkeypatch):
    folder, state = scratch_path(spark, "facts"), scratch_path(spark, "state")
    os.makedirs(folder.removeprefix("file:"))
    s = sums(spark, folder, state)
    assert s.refresh() == {"read": 0, "forgotten": 0, "left": 0} and s.view().collect() == []
    fact(spark, [(1, "a", 1, 1)]).write.mode("append").parquet(folder)
    other, whole = sums(spark, folder, state), IncrementalSums._sums

    def meanwhile(self, files):
        monkeypatch.setattr(IncrementalSums, "_sums", whole)
        other.refresh()
        return whole(self, files)

    monkeypatch.setattr(IncrementalSums, "_sums", meanwhile)
    with pytest.raises(publish.Conflict):
        s.refresh()
    assert [tuple(r)[2] for r in s.view().collect()] == [1]
