"""User code per group (U4) that splits a group of any size over tasks.

The user gives three functions over pandas frames: ``partial`` turns some rows of one group into a state (a dict of
the state's columns), ``merge`` turns several states of a group into one, ``finish`` turns the last state into the result's
columns.  Rows reach ``partial`` in Arrow batches where they lie, before any shuffle; a task folds its states as it goes and
hands them on whenever it holds ``HELD`` groups.  States then meet by (group, salt) and last by group, so a group with
a third of all rows costs its last task a bounded number of states and no row.

``merge`` has to be associative and commutative, as batches come in any order.

Defined results: null keys are a group (all-null keys, too); an empty table gives no rows; repeated rows count each; column names may
be any; keys come back with their types (maps and intervals are no keys).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

HELD = 10_000
SALT = 64
#: Timestamps keep their microseconds on the way through a key's text.
_TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def per_group(df: DataFrame, keys: list[str], columns: list[str], partial: Callable[[pd.DataFrame], dict], state: str,
              merge: Callable[[pd.DataFrame], dict], finish: Callable[[dict], dict], result: str) -> DataFrame:
    """``keys`` plus the columns of ``result`` (DDL, as ``state``), one row a group; ``columns`` are those ``partial`` sees."""
    def name(c: str) -> str:
        return "`" + c.replace("`", "``") + "`"

    kinds, out = StructType.fromDDL(state), StructType.fromDDL(result)
    held_as = StructType([StructField("_key", StringType()), StructField("_salt", IntegerType()), *kinds.fields])
    key_type = StructType([StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)])
    key = F.to_json(F.struct(*[F.col(name(k)).alias(f"k{i}") for i, k in enumerate(keys)]), _TEXT)
    rows = df.select(key.alias("_key"), *[F.col(name(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f.name for f in kinds.fields]

    def fold(states: pd.DataFrame) -> pd.DataFrame:
        again = states["_key"].duplicated(keep=False)
        merged = [{"_key": k, **merge(part[names].reset_index(drop=True))} for k, part in states[again].groupby("_key", sort=False)]
        return pd.concat([states[~again], pd.DataFrame(merged, columns=["_key", *names])], ignore_index=True) if merged else states

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = TaskContext.get().partitionId() % SALT
        held = None
        for frame in frames:
            found = [{"_key": k, **partial(part.drop(columns="_key").set_axis(columns, axis=1).reset_index(drop=True))}
                     for k, part in frame.groupby("_key", sort=False)]
            new = pd.DataFrame(found, columns=["_key", *names])
            held = new if held is None else fold(pd.concat([held, new], ignore_index=True))
            if len(held) >= HELD:
                yield held.assign(_salt=salt)[held_as.names]
                held = None
        if held is not None and len(held):
            yield held.assign(_salt=salt)[held_as.names]

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        return fold(frame.drop(columns="_salt")).assign(_salt=0)[held_as.names]

    def end(frame: pd.DataFrame) -> pd.DataFrame:
        last = fold(frame.drop(columns="_salt"))
        return pd.DataFrame([{"_key": last["_key"][0], **finish({n: last[n][0] for n in names})}])[["_key", *out.names]]

    states = rows.mapInPandas(gather, held_as).groupBy("_key", "_salt").applyInPandas(meet, held_as)
    ended = states.groupBy("_key").applyInPandas(end, StructType([StructField("_key", StringType()), *out.fields]))
    parsed = ended.withColumn("_key", F.from_json("_key", key_type, {"timestampFormat": _TEXT["timestampFormat"]}))
    return parsed.select(*[F.col("_key")[f"k{i}"].alias(k) for i, k in enumerate(keys)], *out.names)
