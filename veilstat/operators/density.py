"""Densities of numeric columns from square-wave reports: binning, transition matrix, expectation maximisation."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.functions.mechanisms import SquareWave

from .aggregate import tidy
from .randomize import square_wave


def report_bins(reports: DataFrame, sw: SquareWave, m: int) -> DataFrame:
    """j, h: reports in each of m equal bins over [-w/2, 1 + w/2], empty ones included, the last closed."""
    cell = (1 + sw.w) / m
    j = F.least(F.floor((F.col("y") + sw.w / 2) / F.lit(cell)), F.lit(m - 1)).cast("long")
    counts = reports.select(j.alias("j")).groupBy("j").agg(F.count("*").alias("h"))
    return reports.sparkSession.range(m).withColumnRenamed("id", "j").join(counts, "j", "left").select("j", F.coalesce("h", F.lit(0)).alias("h"))


def matrix(spark: SparkSession, sw: SquareWave, m: int, n: int) -> DataFrame:
    """j, i, p: mean chance that a value in cell i of n is reported in bin j of m; exact for any numbers of bins."""
    w, mc, nc = sw.w, (1 + sw.w) / m, 1 / n

    def ramp(t):
        return F.pow(F.greatest(t, F.lit(0.0)), F.lit(2.0)) / 2

    def over(x):  # integral over the cell of the overlap of its plateau with [.., x)
        v0 = F.col("i") * F.lit(nc)
        v1 = v0 + F.lit(nc)
        return (ramp(x - v0 + w / 2) - ramp(x - v0 - w / 2)) - (ramp(x - v1 + w / 2) - ramp(x - v1 - w / 2))

    lo = F.lit(-w / 2) + F.col("j") * F.lit(mc)
    bins = spark.range(m).withColumnRenamed("id", "j").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return bins.select("j", "i", (F.lit(sw.q * mc) + F.lit(sw.p - sw.q) * (over(lo + F.lit(mc)) - over(lo)) / F.lit(nc)).alias("p"))


def em_steps(counts: DataFrame, transition: DataFrame, n: int, rounds: int, smooth: bool = False) -> DataFrame:
    """i, theta after a fixed number of rounds, as joins and sums: for checks, and where bins are many."""
    theta = counts.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(1.0 / n).alias("theta"))
    both = transition.join(F.broadcast(counts), "j")  # bins times cells, a number of its own, not of the data
    for _ in range(rounds):
        here = both.join(F.broadcast(theta), "i").cache()
        z = here.groupBy("j").agg(F.sum(F.col("p") * F.col("theta")).alias("z"))
        t = here.join(F.broadcast(z), "j").groupBy("i").agg((F.first("theta") * F.sum(F.col("p") * F.col("h") / F.col("z"))).alias("t"))
        total = t.agg(F.sum("t").alias("s"))
        theta = t.crossJoin(F.broadcast(total)).select("i", (F.col("t") / F.col("s")).alias("theta"))
        if smooth:
            theta = _smoothed(theta, n)
        rows = theta.collect()  # one row per cell; keeps the plan of the next round short
        here.unpersist()
        theta = counts.sparkSession.createDataFrame(rows, "i long, theta double")
    return theta


def _smoothed(theta: DataFrame, n: int) -> DataFrame:
    w = F.array(F.struct(F.lit(-1).alias("d"), F.lit(1.0).alias("c")), F.struct(F.lit(0).alias("d"), F.lit(2.0).alias("c")), F.struct(F.lit(1).alias("d"), F.lit(1.0).alias("c")))
    spread = theta.select("i", "theta", F.explode(w).alias("w")).select((F.col("i") + F.col("w.d")).alias("i"), (F.col("theta") * F.col("w.c")).alias("t"), F.col("w.c").alias("c"))
    mean = spread.where(f"i >= 0 and i < {n}").groupBy("i").agg((F.sum("t") / F.sum("c")).alias("theta"))
    return mean.crossJoin(F.broadcast(mean.agg(F.sum("theta").alias("s")))).select("i", (F.col("theta") / F.col("s")).alias("theta"))


def _transition(sw: SquareWave, m: int, n: int) -> np.ndarray:
    w, mc, nc = sw.w, (1 + sw.w) / m, 1 / n
    lo, v = (-w / 2 + np.arange(m + 1) * mc)[:, None], (np.arange(n + 1) * nc)[None]

    def ramp(t):
        return np.maximum(t, 0) ** 2 / 2

    f = ramp(lo - v + w / 2) - ramp(lo - v - w / 2)
    over = f[:, :-1] - f[:, 1:]
    return sw.q * mc + (sw.p - sw.q) * (over[1:] - over[:-1]) / nc


def em(h: Iterable[float], sw: SquareWave, n: int, smooth: bool = False, most: int = 10_000, tol: float = 1e-3) -> np.ndarray:
    """Shares of the n cells from report counts, to convergence; sums to 1. smooth: with a [1, 2, 1] filter each round."""
    h = np.asarray(list(h), float)
    mat = _transition(sw, len(h), n)
    theta, last = np.full(n, 1 / n), -math.inf
    for r in range(most):
        z = mat @ theta
        new = theta * (mat.T @ (h / z))
        new /= new.sum()
        if smooth:
            k = np.convolve(np.ones(n), [1, 2, 1], "same")
            new = np.convolve(new, [1, 2, 1], "same") / k
            new /= new.sum()
        moved, theta = np.abs(new - theta).sum(), new
        like = float(h @ np.log(mat @ theta))
        if moved <= 1 / max(h.sum(), 1) or r > 1 and abs(like - last) < tol:
            break
        last = like
    return theta


def density(users: DataFrame, key: str, value: str, eps: float, bins: int, low: float, high: float, smooth: bool = False, salt: str = "s") -> DataFrame:
    """i, share, est of a numeric column on [low, high]: reports and their binning run on the cluster, the fit on bins."""
    sw = SquareWave(eps)
    scaled = users.withColumn("_s", (F.col(value) - low) / (high - low))
    counts = [r["h"] for r in report_bins(square_wave(scaled, key, "_s", sw, salt), sw, bins).orderBy("j").collect()]
    theta = em(counts, sw, bins, smooth)
    rows = [(i, float(t), float(t * sum(counts))) for i, t in enumerate(theta)]
    return users.sparkSession.createDataFrame(rows, "i long, share double, est double")


__all__ = ["density", "em", "em_steps", "matrix", "report_bins", "tidy"]
