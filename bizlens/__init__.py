"""bizlens: business-table analytics as Spark DataFrame jobs.

Families: profiling, validity checks, account-risk analytics, weekly operating
metrics, subscription retention and a boosted-tree churn score.  Every operator
builds a lazy DataFrame; nothing row-level passes through the driver.
"""

__all__ = ["session"]
