"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ensure_checkpoint_dir
from ..sources.scratch import scratch_path, written_table

#: White space of the word contracts: blank and the code points 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

#: Rows per Arrow batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 256
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name as ``F.col`` reads it, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened until no column of ``df`` is called so (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def ready_python(spark: SparkSession) -> None:
    """Prepare a session for Python stages: bound their Arrow batches (texts may be long, and a
    batch is held whole in a worker; a smaller value set by the user stays), and ship this package
    to the executors, which may not have it installed."""
    if int(spark.conf.get(_BATCH_CONF, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        bundle = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}-package.zip"
        with zipfile.ZipFile(bundle, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(bundle))       # Spark sends it from the driver to every executor
        _SHIPPED.add(sc.applicationId)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType) -> DataFrame:
    """``mapInPandas`` for columns of any name (Spark's takes none with a dot or a back-tick): frames carry the names
    of ``df``, rows travel under plain ones."""
    given, out = df.columns, [f.name for f in schema.fields]
    within, without = [f"c{i}" for i in range(len(given))], [f"c{i}" for i in range(len(out))]

    def renamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in run(f.set_axis(given, axis=1) for f in frames):
            yield done[out].set_axis(without, axis=1)

    inner = StructType([StructField(n, f.dataType) for n, f in zip(without, schema.fields)])
    return df.toDF(*within).mapInPandas(renamed, inner).toDF(*out)


def held_out(doc_id: Column) -> Column:
    """True for the fold kept out of training: crc32(doc_id as text) mod 4 is 2
    (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def pieces(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose sizes add up to about ``limit``; a larger row stands alone."""
    start = end = total = 0
    for n in sizes:
        if end > start and total + n > limit:
            yield start, end
            start, total = end, 0
        end += 1
        total += n
    if end > start:
        yield start, end


__all__ = ["SPACE_CLASS", "WORD", "ensure_checkpoint_dir", "held_out", "map_frames", "pieces", "quoted", "ready_python",
           "scratch_path", "table", "unused", "written_table"]
