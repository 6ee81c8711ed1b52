"""Scalar numeric helpers (X1, X2, X15) and the arithmetic conventions.

* Money is summed as DECIMAL so sums are exact and order-independent; the sum is
  converted to DOUBLE only at the output.
* Ratios never raise on a zero denominator (Spark runs ANSI): ``ratio`` gives
  NULL, ``ratio0`` gives 0 (the reference's dashboard convention).
* ``rnd`` rounds a DOUBLE with ties to the even digit as ``bround(x * 10^k) / 10^k``, the
  convention of the reference's rounded outputs; the formula evaluates identically in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "DECIMAL(18,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x) -> Column:
    return _c(x).cast(MONEY)


def dbl(x) -> Column:
    return _c(x).cast("double")


def rnd(x, k: int) -> Column:
    """Round a double to k decimals, ties to the even digit."""
    scale = float(10 ** k)
    return F.bround(dbl(x) * F.lit(scale), 0) / F.lit(scale)


def ratio(num, den) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL."""
    return F.try_divide(dbl(num), dbl(den))


def ratio0(num, den) -> Column:
    """num / den as DOUBLE, 0 when den is 0 (dashboard convention)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def half_even(x, k: int) -> Column:
    """Python ``round`` (banker's) on a decimal value: ``bround``."""
    return F.bround(_c(x), k)


def js_round(x) -> Column:
    """JavaScript ``Math.round``: half toward +infinity."""
    return F.floor(dbl(x) + F.lit(0.5))
