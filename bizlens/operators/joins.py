"""Small join sides whose size is derived from the data.

``bounded_broadcast`` broadcasts such a side only after its size is known: the side
is materialized first (a parquet table under ``spark.checkpoint.dir``, so it is
computed once and survives executor loss), its exact row count is read from the
written files, and only up to ``max_rows`` is it broadcast.  Beyond that the
materialized side is returned as is and the planner shuffles both sides.

Without it, a dictionary built by aggregating a large table (distinct tiers of every
account, say) carries its input's size estimate into planning, so the join is
planned as a sort-merge join and the large side is shuffled before AQE can measure
the dictionary and demote the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written_table

DICT_BROADCAST_MAX_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = DICT_BROADCAST_MAX_ROWS) -> DataFrame:
    side = written_table(df, "dict")
    return F.broadcast(side) if side.count() <= max_rows else side
