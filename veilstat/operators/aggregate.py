"""Server side: support counts of reports, unbiased estimates over complete domains, filters of estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstat.functions.mechanisms import Mechanism
from veilstat.functions.rng import hashed

#: Whole-table windows below run over one row per value of a domain, never over reports.


def whole():
    """A window over the whole table."""
    return Window.partitionBy()


def tidy(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def supports(m: Mechanism, v: Column | str) -> Column:
    """Whether a report (y, and a, b) supports value v."""
    v = F.col(v) if isinstance(v, str) else v
    return hashed("a", "b", v, m.size) == F.col("y") if m.hashes else F.col("y") == v


def support_counts(reports: DataFrame, m: Mechanism, by: list[str] | None = None) -> DataFrame:
    """by, v, c, n: reports that support each value of the domain, zeros included, and reports in all.

    One pass: each report gives the values it supports and a mark that counts it, which combine on the map side.
    """
    by = by or []
    if m.kind == "ue":
        seen = F.array(F.col("y"))  # its mark of -1 is a row already
    elif m.hashes:
        every = F.sequence(F.lit(0).cast("long"), F.lit(m.d - 1).cast("long"))
        seen = F.concat(F.array(F.lit(-1).cast("long")), F.filter(every, lambda v: supports(m, v)))
    else:
        seen = F.array(F.lit(-1).cast("long"), F.col("y"))
    counts = reports.select(*by, F.explode(seen).alias("v")).groupBy(*by, "v").agg(F.count("*").alias("c"))
    domain = reports.sparkSession.range(-1, m.d).withColumnRenamed("id", "v")
    if by:
        domain = counts.where("v = -1").select(*by).crossJoin(F.broadcast(domain))
        full = domain.join(counts, [*by, "v"], "left")
    else:
        full = domain.join(counts, "v", "left")
    w = Window.partitionBy(*by) if by else whole()
    full = full.withColumn("n", F.coalesce(F.max(F.when(F.col("v") == -1, F.col("c"))).over(w), F.lit(0)))
    return full.where("v >= 0").select(*by, "v", F.coalesce("c", F.lit(0)).alias("c"), "n")


def histogram(reports: DataFrame, m: Mechanism, by: list[str] | None = None) -> DataFrame:
    """by, v, est: unbiased counts; they may be negative."""
    counts = support_counts(reports, m, by)
    return counts.select(*(by or []), "v", tidy(m.estimate(F.col("c"), F.col("n"))).alias("est"))


def drop_noise(est: DataFrame, floor: float) -> DataFrame:
    """Estimates below the noise floor become 0."""
    return est.withColumn("est", F.when(F.col("est") < floor, 0.0).otherwise(F.col("est")))


def _rank() -> Column:
    return F.row_number().over(whole().orderBy(F.desc("est"), "v"))


def keep_largest(est: DataFrame, k: int) -> DataFrame:
    """The k largest estimates, at least 1 each; the others 0."""
    return est.withColumn("_r", _rank()).withColumn("est", F.when(F.col("_r") <= k, F.greatest("est", F.lit(1.0))).otherwise(0.0)).drop("_r")


def mark_largest(est: DataFrame, k: int) -> DataFrame:
    """Negative estimates 0, and all but the k largest -1."""
    d = est.withColumn("est", F.greatest("est", F.lit(0.0)))
    return d.withColumn("_r", _rank()).withColumn("est", F.when(F.col("_r") <= k, F.col("est")).otherwise(-1.0)).drop("_r")


def largest(est: DataFrame, k: int) -> DataFrame:
    """The k rows with the largest estimates, ties to the smaller value."""
    return est.orderBy(F.desc("est"), "v").limit(k)
