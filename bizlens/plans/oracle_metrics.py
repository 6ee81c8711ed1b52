"""The weekly metrics once more, as SQL text written out for the oracle.

Nothing here comes from ``functions.metrics``: a wrong numerator there shows as a mismatch.
"""

from __future__ import annotations

SUMS = ["camp", "funded", "fast", "goal", "gdv", "don", "donors", "retdon", "fromdon", "repeatorg", "tips", "procrev",
        "proccost", "rev", "refunds", "refamt", "cb", "fraud", "spend"]
MONEY_SUMS = {"goal", "gdv", "tips", "procrev", "proccost", "rev", "refamt"}
CONDITIONAL = {
    "paid_camp": "sum(CASE WHEN paid = 1 THEN camp ELSE 0 END)",
    "paid_spend": "sum(CASE WHEN paid = 1 THEN spend ELSE 0 END)",
    "pay_weighted": "sum(paydays_x100 * camp)",
}
# metric: (numerator, denominator, factor)
RATIOS = {
    "takeRate": ("rev", "gdv", 1),
    "tipRate": ("tips", "gdv", 1),
    "procRate": ("procrev - proccost", "gdv", 1),
    "avgDonation": ("gdv", "don", 1),
    "fundedRate": ("funded", "camp", 1),
    "attainment": ("gdv", "goal", 1),
    "fastRate": ("fast", "camp", 1),
    "donPerCamp": ("don", "camp", 1),
    "repeatDonor": ("retdon", "donors", 1),
    "viralShare": ("fromdon", "camp", 1),
    "repeatOrg": ("repeatorg", "camp", 1),
    "paidShare": ("paid_camp", "camp", 1),
    "paidCac": ("paid_spend", "paid_camp", 1),
    "refundRate": ("refamt", "gdv", 1),
    "cbRate": ("cb", "don", 1),
    "fraudRate": ("fraud", "camp", 1),
    "payoutDays": ("pay_weighted", "camp", 0.01),
}
LOWER_IS_BETTER = {"paidShare", "paidCac", "refundRate", "cbRate", "fraudRate", "payoutDays"}
TREND = ["gdv", "rev", "takeRate", "avgDonation", "fundedRate", "repeatDonor", "paidCac"]
KPI_DELTAS = ["gdv", "rev", "takeRate", "don", "avgDonation", "camp", "fundedRate", "attainment", "fastRate", "donPerCamp",
              "repeatDonor", "viralShare", "repeatOrg", "paidShare", "paidCac", "refundRate", "cbRate", "fraudRate", "payoutDays"]
CATEGORY_RATES = {'fast': 'fastRate',
 'funded': 'fundedRate',
 'attain': 'attainment',
 'repeat_donor': 'repeatDonor',
 'avg_don': 'avgDonation',
 'refund': 'refundRate',
 'fraud': 'fraudRate'}


def measure_sql() -> str:
    return ", ".join([f"sum({c}) AS {c}" for c in SUMS] + [f"{sql} AS {k}" for k, sql in CONDITIONAL.items()])


def ratio_sql(name: str) -> str:
    num, den, factor = RATIOS[name]
    value = f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0)"
    return value if factor == 1 else f"({value} * {factor})"


def metric_sql(name: str) -> str:
    return ratio_sql(name) if name in RATIOS else f"CAST({name} AS DOUBLE)"


def lower_is_better(name: str) -> bool:
    return name in LOWER_IS_BETTER


def rnd_sql(expr: str, k: int) -> str:
    """k decimals, ties to the even digit."""
    s = float(10 ** k)
    return f"(round_even(CAST({expr} AS DOUBLE) * {s}, 0) / {s})"
