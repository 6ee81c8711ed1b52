"""Sums over a growing folder of fact files, from new files only (A15 on new data).

Measures are additive, so a file's sums per key never change while the file does not.  The state holds a manifest (file,
size, time, the delta that has its sums) and deltas (file, keys, sums).  ``refresh`` compares the manifest with the
folder's listing, reads new and changed files in one job, writes their sums as one more delta and commits both at once
(``publish``); sums of files that are gone or changed lose their manifest row and count no more.  ``view`` adds up the
deltas' rows that the manifest names.  After ``MERGE`` deltas the rows still named are written as one, without a
look at the source.

The source's rows are grouped by (file, keys) with partial sums before any shuffle; what is collected is the names
of new files, fewer than Spark's own listing of them.

Defined results: an empty folder gives an empty view; null keys are a group; a measure that is null in all rows of a
group is null; integer and decimal sums equal a full run exactly, floating ones but for the order of addition; a
file replaced while it is read is read again by the next refresh; two refreshes at once: the later raises ``Conflict``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .publish import commit, latest

MERGE = 16
_FILE, _DELTA = "_source_file", "_source_delta"


@dataclass
class IncrementalSums:
    spark: SparkSession
    source: str                     # folder of parquet files with columns of ``schema``
    state: str                      # folder of the state
    schema: StructType
    keys: list[str]
    measures: dict[str, Column]     # name: expression over a row

    def listing(self) -> DataFrame:
        """(file, size, modified) of the folder's files; contents are not read."""
        meta = F.col("_metadata")
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.source) \
            .select(meta["file_path"].alias("file"), meta["file_size"].alias("size"),
                    F.unix_micros(meta["file_modification_time"]).alias("modified"))

    def _delta(self, folder: str, body: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(body["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.state}/{folder}").withColumn(_DELTA, F.lit(folder))

    def _named(self, body: dict) -> DataFrame:
        """Rows of all deltas that the manifest names."""
        rows = reduce(DataFrame.unionByName, [self._delta(f, body) for f in body["deltas"]])
        manifest = self._manifest(body).select(F.col("file").alias(_FILE), F.col("delta").alias(_DELTA))
        return rows.join(manifest, [_FILE, _DELTA], "left_semi")

    def _manifest(self, body: dict) -> DataFrame:
        return self.spark.read.schema("file string, size bigint, modified bigint, delta string") \
            .parquet(f"{self.state}/{body['manifest']}")

    def _sums(self, files: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*[unquote(f) for f in files])
        return rows.groupBy(F.col("_metadata.file_path").alias(_FILE), *self.keys) \
            .agg(*[F.sum(c).alias(m) for m, c in self.measures.items()])

    def refresh(self) -> dict[str, int]:
        """Bring the state up to the folder; returns how many files were read, forgotten and left alone."""
        number, body = latest(self.spark, self.state)
        nothing = self.spark.createDataFrame([], "file string, size bigint, modified bigint, delta string")
        old = (self._manifest(body) if number else nothing).withColumnsRenamed({"size": "old_size", "modified": "old_modified"})
        both = self.listing().join(old, "file", "full")
        same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified"))
        both = both.select("*", F.when(F.col("size").isNull(), "gone").when(same, "same").otherwise("new").alias("what"),
                           F.col("old_size").isNotNull().alias("known"))
        tally = both.groupBy("what", "known").count().collect()
        done = {"read": sum(r["count"] for r in tally if r["what"] == "new"),
                "forgotten": sum(r["count"] for r in tally if r["what"] != "same" and r["known"]),
                "left": sum(r["count"] for r in tally if r["what"] == "same")}
        if number and not done["read"] and not done["forgotten"]:
            return done
        deltas, added = list(body.get("deltas", [])), f"delta-{uuid.uuid4().hex}"
        schema = body.get("schema")
        new = [r["file"] for r in both.where("what = 'new'").select("file").collect()]
        if new:
            sums = self._sums(new)
            sums.write.parquet(f"{self.state}/{added}")
            schema = sums.schema.json()
            deltas.append(added)
        manifest = f"manifest-{uuid.uuid4().hex}"
        both.where("what != 'gone'").select("file", "size", "modified", F.when(F.col("what") == "new", added)
                                            .otherwise(F.col("delta")).alias("delta")).write.parquet(f"{self.state}/{manifest}")
        after = {"deltas": deltas, "manifest": manifest, "schema": schema}
        if len(deltas) > MERGE:
            after = self._merged(after)
        commit(self.spark, self.state, [after["manifest"], *after["deltas"]], after, expected=number)
        return done

    def _merged(self, body: dict) -> dict:
        one, manifest = f"delta-{uuid.uuid4().hex}", f"manifest-{uuid.uuid4().hex}"
        self._named(body).drop(_DELTA).write.parquet(f"{self.state}/{one}")
        self._manifest(body).withColumn("delta", F.lit(one)).write.parquet(f"{self.state}/{manifest}")
        return body | {"deltas": [one], "manifest": manifest}

    def view(self) -> DataFrame:
        """The measures per key over all files of the last refresh."""
        number, body = latest(self.spark, self.state)
        if not number or not body["deltas"]:
            empty = self.spark.createDataFrame([], self.schema).groupBy(*self.keys)
            return empty.agg(*[F.sum(c).alias(m) for m, c in self.measures.items()])
        return self._named(body).groupBy(*self.keys).agg(*[F.sum(m).alias(m) for m in self.measures])
