"""Column names of any kind: dots, back-ticks, blanks, names that differ by case only."""

from __future__ import annotations

from pyspark.sql import DataFrame


def quoted(name: str) -> str:
    """A name as ``F.col`` reads it, taken literally."""
    return "`" + name.replace("`", "``") + "`"


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called ``_c0``, ``_c1`` ..., and what each was called.  Jobs over all columns
    work on these and write the original names out as values, so no name can be misread."""
    keys = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*keys), dict(zip(keys, df.columns))


def position(df: DataFrame, name: str) -> str:
    """The positional name of column ``name``."""
    return f"_c{df.columns.index(name)}"
