"""Metric registry (U1) and watch registry.

Only additive measures are aggregated; every ratio is derived after the
aggregation, so any roll-up (group, cube, window) recomputes rates instead of
averaging pre-baked ones.  The registry is declarative: a ratio is a numerator
expression over aggregated measures and a denominator measure, which lets the
same entry serve every roll-up.  The oracle writes the metrics out once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import dbl, rnd

# Additive measures of the weekly fact, by the names of the source's fields.
SUMS = ["camp", "funded", "fast", "goal", "gdv", "don", "donors", "retdon", "fromdon",
        "repeatorg", "tips", "procrev", "proccost", "rev", "refunds", "refamt", "cb",
        "fraud", "spend"]
MONEY_SUMS = {"goal", "gdv", "tips", "procrev", "proccost", "rev", "refamt"}

# Conditional / weighted sums.
EXTRA = {
    "paid_camp": lambda: F.when(F.col("paid") == 1, F.col("camp")).otherwise(F.lit(0)),
    "paid_spend": lambda: F.when(F.col("paid") == 1, F.col("spend")).otherwise(F.lit(0)),
    "pay_weighted": lambda: F.col("paydays_x100") * F.col("camp"),
}


@dataclass(frozen=True)
class Ratio:
    num: str            # expression over aggregated measures (valid in Spark SQL and DuckDB)
    den: str            # aggregated measure
    scale: float = 1.0  # applied after the division
    lower_is_better: bool = False


# The 17 ratio metrics; each is 0 when its denominator is 0.
RATIOS: dict[str, Ratio] = {
    "takeRate": Ratio("rev", "gdv"),
    "tipRate": Ratio("tips", "gdv"),
    "procRate": Ratio("procrev - proccost", "gdv"),
    "avgDonation": Ratio("gdv", "don"),
    "fundedRate": Ratio("funded", "camp"),
    "attainment": Ratio("gdv", "goal"),
    "fastRate": Ratio("fast", "camp"),
    "donPerCamp": Ratio("don", "camp"),
    "repeatDonor": Ratio("retdon", "donors"),
    "viralShare": Ratio("fromdon", "camp"),
    "repeatOrg": Ratio("repeatorg", "camp"),
    "paidShare": Ratio("paid_camp", "camp", lower_is_better=True),
    "paidCac": Ratio("paid_spend", "paid_camp", lower_is_better=True),
    "refundRate": Ratio("refamt", "gdv", lower_is_better=True),
    "cbRate": Ratio("cb", "don", lower_is_better=True),
    "fraudRate": Ratio("fraud", "camp", lower_is_better=True),
    "payoutDays": Ratio("pay_weighted", "camp", scale=0.01, lower_is_better=True),
}

# The seven trend metrics selectable on the weekly report.
TREND = ["gdv", "rev", "takeRate", "avgDonation", "fundedRate", "repeatDonor", "paidCac"]
# KPI tiles that carry a week-over-week delta (lower-is-better ones are flipped).
KPI_DELTAS = ["gdv", "rev", "takeRate", "don", "avgDonation", "camp", "fundedRate",
              "attainment", "fastRate", "donPerCamp", "repeatDonor", "viralShare",
              "repeatOrg", "paidShare", "paidCac", "refundRate", "cbRate", "fraudRate",
              "payoutDays"]


def measure_aggs(prefix: str = "") -> list[Column]:
    """Sum expressions for the additive measures (usable in groupBy/cube/rollup)."""
    out = [F.sum(c).alias(prefix + c) for c in SUMS]
    out += [F.sum(f()).alias(prefix + k) for k, f in EXTRA.items()]
    return out


def ratio_col(name: str) -> Column:
    r = RATIOS[name]
    val = F.coalesce(F.try_divide(dbl(F.expr(r.num)), dbl(r.den)), F.lit(0.0))
    return val * F.lit(r.scale) if r.scale != 1.0 else val


def metric_col(name: str) -> Column:
    """Any registered metric: a ratio, or an additive measure as DOUBLE."""
    return ratio_col(name) if name in RATIOS else dbl(name)


def lower_is_better(name: str) -> bool:
    return name in RATIOS and RATIOS[name].lower_is_better


@dataclass(frozen=True)
class Watch:
    """A watched metric for the movers list: the dimension it is broken down by and
    the minimum count its aggregate must reach, in both weeks, to be reportable."""
    metric: str
    dim: str
    label: str
    guard_measure: str
    guard_min: float


# The reference's watch list with its absolute guards.
WATCH = [
    Watch("gdv", "category", "GDV", "camp", 300),
    Watch("takeRate", "category", "take rate", "gdv", 2e6),
    Watch("refundRate", "category", "refund rate", "refunds", 250),
    Watch("fraudRate", "category", "fraud rate", "fraud", 25),
    Watch("paidCac", "channel", "paid CAC", "paid_camp", 400),
]


def scaled_watch(factor: float) -> list[Watch]:
    """Same list with every guard multiplied by ``factor`` (guards are parameters)."""
    return [Watch(w.metric, w.dim, w.label, w.guard_measure, w.guard_min * factor) for w in WATCH]
