"""Spark-vs-DuckDB comparison used by the oracle tests (mirrors the driver's check:
column names, row count, order-insensitive values)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits)
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


def rows_of_spark(df, digits):
    cols = sorted(df.columns)
    out = []
    for r in df.collect():
        d = r.asDict(recursive=True)
        out.append(tuple(_norm(d[c], digits) for c in cols))
    return cols, out


def rows_of_duck(con, sql, digits):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    return cols, [tuple(_norm(r[i], digits) for i in order) for r in data]


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark_df, con, sql, digits: int = 9):
    import os
    digits = int(os.environ.get("COMPARE_DIGITS", digits))
    """Returns (ok, message).  Exact match on normalised values."""
    sc, sr = rows_of_spark(spark_df, digits)
    dc, dr = rows_of_duck(con, sql, digits)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    ss, ds = sorted(sr, key=_key), sorted(dr, key=_key)
    for a, b in zip(ss, ds):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(sc, a, b) if x != y]
            return False, f"first differing row: {diff[:6]}"
    return True, f"{len(sr)} rows match"


def spark_type_name(dt) -> str:
    from pyspark.sql import types as T
    m = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
         T.DateType: "DATE", T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP", T.FloatType: "FLOAT",
         T.ShortType: "SMALLINT", T.ByteType: "TINYINT"}
    return m.get(type(dt), dt.simpleString())


def type_diff(spark_df, con, sql) -> dict:
    """Columns whose Spark type and DuckDB type differ (name -> (spark, duckdb))."""
    rel = con.sql(sql)
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    st = {f.name: spark_type_name(f.dataType) for f in spark_df.schema.fields}
    return {c: (st[c], dt.get(c)) for c in st if st[c] != dt.get(c)}
