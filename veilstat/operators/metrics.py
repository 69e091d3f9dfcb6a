"""Errors of estimates against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import tidy


def histogram_error(est: DataFrame, truth: DataFrame) -> DataFrame:
    """mse, mae over the domain of est(v, est) against truth(v, c); a missing value counts as 0."""
    d = est.join(truth, "v", "full").select(F.coalesce("est", F.lit(0.0)).alias("e"), F.coalesce("c", F.lit(0)).alias("c"))
    return d.agg(tidy(F.avg(F.pow(F.col("e") - F.col("c"), F.lit(2.0))), 3).alias("mse"), tidy(F.avg(F.abs(F.col("e") - F.col("c")))).alias("mae"))


def query_error(est: DataFrame, truth: DataFrame, column: str, total: float) -> DataFrame:
    """query, squared, of_total, relative (0 where the truth is not positive)."""
    d = est.select("query", F.col(column).alias("e")).join(truth.select("query", F.col(column).alias("t")), "query")
    gap = F.abs(F.col("e") - F.col("t"))
    return d.select("query", tidy(gap * gap, 3).alias("squared"), tidy(gap / total).alias("of_total"), tidy(F.when(F.col("t") > 0, gap / F.col("t")).otherwise(0.0)).alias("relative"))
