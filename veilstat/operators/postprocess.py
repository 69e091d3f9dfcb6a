"""Consistency of noisy histograms: (v, est) over a complete domain in, the same shape out; n is the number of users.

All steps are windows over one row per value; iterative ones are unrolled in closed form where one exists.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstat.functions.mechanisms import Mechanism

from .aggregate import tidy, whole



def _down():
    return whole().orderBy(F.desc("est"), "v").rowsBetween(Window.unboundedPreceding, 0)


def base_pos(est: DataFrame) -> DataFrame:
    return est.withColumn("est", F.greatest("est", F.lit(0.0)))


non_neg = base_pos


def norm(est: DataFrame, n: float) -> DataFrame:
    """The same shift for all, so that the sum is n."""
    return est.withColumn("est", tidy(F.col("est") + (F.lit(float(n)) - F.sum("est").over(whole())) / F.count("*").over(whole())))


def norm_mul(est: DataFrame, n: float) -> DataFrame:
    """Negatives to 0, then scaled to the sum n; zeros if nothing is positive."""
    d = base_pos(est)
    s = F.sum("est").over(whole())
    return d.withColumn("est", tidy(F.when(s > 0, F.col("est") * n / s).otherwise(0.0)))


def norm_cut(est: DataFrame, n: float) -> DataFrame:
    """From the largest down until the running sum passes n; the rest 0; scaled to n. If it never passes, all are scaled."""
    d = est.withColumn("_r", F.row_number().over(whole().orderBy(F.desc("est"), "v"))).withColumn("_s", F.sum("est").over(_down()))
    d = d.withColumn("_k", F.coalesce(F.min(F.when(F.col("_s") > n, F.col("_r"))).over(whole()), F.count("*").over(whole())))
    d = d.withColumn("_t", F.max(F.when(F.col("_r") == F.col("_k"), F.col("_s"))).over(whole()))
    return d.withColumn("est", tidy(F.when(F.col("_r") <= F.col("_k"), F.col("est") * n / F.col("_t")).otherwise(0.0))).drop("_r", "_s", "_k", "_t")


def norm_sub(est: DataFrame, n: float) -> DataFrame:
    """Negatives to 0 and one shift of the positives, again until the sum is n: the projection onto the simplex.

    Unchanged where nothing is negative and the sum is within 1 of n; zeros if nothing is positive.
    """
    d = est.withColumn("_c", F.greatest("est", F.lit(0.0))).withColumn("_done", (F.abs(F.sum("est").over(whole()) - n) <= 1) & (F.min("est").over(whole()) >= 0))
    down = whole().orderBy(F.desc("_c"), "v")
    d = d.withColumn("_k", F.row_number().over(down)).withColumn("_s", F.sum("_c").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    total, positive = F.sum("_c").over(whole()), F.sum(F.when(F.col("_c") > 0, 1).otherwise(0)).over(whole())
    d = d.withColumn("_total", total).withColumn("_pos", positive)
    fits = (F.col("_c") > 0) & (F.col("_c") > (F.col("_s") - n) / F.col("_k"))
    d = d.withColumn("_rho", F.max(F.when(fits, F.col("_k"))).over(whole()))
    d = d.withColumn("_cut", F.max(F.when(F.col("_k") == F.col("_rho"), (F.col("_s") - n) / F.col("_k"))).over(whole()))
    shift = F.when(F.col("_total") <= n, (n - F.col("_total")) / F.col("_pos")).otherwise(-F.col("_cut"))
    new = F.when(F.col("_done"), F.col("est")).when(F.col("_c") <= 0, 0.0).otherwise(F.greatest(F.col("_c") + shift, F.lit(0.0)))
    return d.withColumn("est", tidy(new)).select(*est.columns)


#: Rounds of the likelihood methods that are planned at once.
ROUNDS = 6


def _mle(est: DataFrame, n: float, m: Mechanism, first: bool, step) -> DataFrame:
    """Rounds until nothing is negative; ROUNDS are planned at once, then one look tells whether more are needed."""
    d = est.withColumn("_o", m.observed(F.col("est"), F.lit(float(n))) / n).withColumn("est", F.col("est") / n)
    done = 0
    while True:  # each round sets a cell to 0 for good, so the rounds end
        for i in range(done, done + ROUNDS):
            again = F.lit(True) if first and not i else F.min("est").over(whole()) < 0
            positive = F.col("est") > 0
            d = d.withColumn("_again", again).withColumn("_k", F.sum(positive.cast("int")).over(whole())).withColumn("_s", F.sum(F.when(positive, F.col("_o")).otherwise(0.0)).over(whole()))
            new = F.when(positive, step(F.col("_o"), F.col("_k"), F.col("_s"))).otherwise(0.0)
            d = d.withColumn("est", F.when(F.col("_again"), new).otherwise(F.col("est")))
        done += ROUNDS
        if (d.agg(F.min("est")).first()[0] or 0) >= 0:
            break
    return d.withColumn("est", tidy(F.col("est") * n)).select(*est.columns)


def mle_apx(est: DataFrame, n: float, m: Mechanism) -> DataFrame:
    """Approximate maximum likelihood; a round that leaves no negatives is the last. Cells once 0 stay 0."""
    p, q = m.p, m.q
    a, b = p * (1 - p), q * (1 - q)

    def step(o, k, s):
        x = (s - p - (k - 1) * q) / (a + (k - 1) * b)
        return (o - q - b * x) / (F.lit(p - q) + (a - b) * x)

    return _mle(est, n, m, True, step)


def mle_grr(est: DataFrame, n: float, m: Mechanism) -> DataFrame:
    """Maximum likelihood under randomised response; unchanged if nothing is negative."""
    p, q = m.p, m.q
    return _mle(est, n, m, False, lambda o, k, s: (o / s * (k * q + (p - q)) - q) / (p - q))


def _power_mean(x: np.ndarray, alpha: float) -> float:
    return float((x ** (1 - alpha)).sum() / (x**-alpha).sum())


def fit_power(mean: float, n: int) -> float:
    """The exponent of a power law over 1..n with this mean, by doubling and halving."""
    if mean < 1:
        return 1.01
    x = np.arange(1, n + 1, dtype=float)
    high = 2.0
    while _power_mean(x, high) > mean:
        high *= 2
    low = high / 2
    for _ in range(1000):
        alpha = (low + high) / 2
        got = _power_mean(x, alpha)
        if abs(got - mean) <= 0.01:
            break
        low, high = (alpha, high) if got > mean else (low, alpha)
    return alpha


def power(est: DataFrame, n: int, m: Mechanism, step: int = 10, reach: int = 25_000) -> DataFrame:
    """Posterior means under a fitted power-law prior and Gaussian noise, on a grid of `step`.

    The mean and the distinct grid places are what leaves the cluster; posteriors are sums over a window of counts.
    """
    var = m.variance * n
    alpha = fit_power(est.agg(F.avg("est")).first()[0], n)
    d = est.withColumn("_g", F.rint(F.col("est") / step).cast("long"))
    places = d.select("_g").distinct().withColumn("_x", F.col("_g") * step + step / 2)
    lo = F.greatest(F.lit(0), F.expr("cast(_x as bigint)") - reach)
    hi = F.least(F.lit(n), F.expr("cast(_x as bigint)") + reach)
    grid = places.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi > _lo").select("_g", "_x", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k"))
    k = F.col("_k").cast("double")
    weight = F.exp(-F.pow(F.col("_x") - k, 2) / (2 * var))
    weight = F.when(weight == 0, 1e-32).otherwise(weight)
    means = grid.groupBy("_g").agg((F.sum(weight * F.pow(k, F.lit(1 - alpha))) / F.sum(weight * F.pow(k, F.lit(-alpha)))).alias("_m"))
    return d.join(means, "_g", "left").withColumn("est", tidy(F.coalesce("_m", F.lit(0.0)), 4)).select(*est.columns)


def power_ns(est: DataFrame, n: float) -> DataFrame:
    """The name that stands for the last step alone."""
    return norm_sub(est, n)


def power_then_norm_sub(est: DataFrame, n: int, m: Mechanism) -> DataFrame:
    """Both steps, as the method is published."""
    return norm_sub(power(est, n, m), n)


def postprocess(est: DataFrame, method: str, n: int, m: Mechanism | None = None) -> DataFrame:
    """The step by name."""
    plain = {"base_pos": base_pos, "non_neg": non_neg}
    summed = {"norm": norm, "norm_mul": norm_mul, "norm_cut": norm_cut, "norm_sub": norm_sub, "power_ns": power_ns}
    modelled = {"mle_apx": mle_apx, "mle_grr": mle_grr, "power": power, "power_then_norm_sub": power_then_norm_sub}
    if method in plain:
        return plain[method](est)
    return summed[method](est, n) if method in summed else modelled[method](est, n, m)
