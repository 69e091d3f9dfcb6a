"""Heavy hitters in a large bit-string domain: groups of users report growing suffixes, candidates are extended and cut."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions.mechanisms import Mechanism, lh_half
from veilstat.functions.rng import u32

from .aggregate import supports, tidy, whole
from .randomize import perturb


def rounds(bits: int, k: int, step: int = 1) -> tuple[int, int]:
    """Bits of the first suffix, and number of rounds."""
    first = int(math.log2(k)) + 1
    return first, 1 + max(0, math.ceil((bits - first) / step))


def extended(candidates: list[int], have: int, want: int) -> list[int]:
    """All candidates with all settings of the bits from `have` to `want`."""
    return sorted({(s << have) + c for c in candidates for s in range(1 << (want - have))})


def round_estimate(users: DataFrame, key: str, value: str, candidates: list[int], shift: int, eps: float, salt: str) -> DataFrame:
    """v, c, n, est of one group: low `shift` bits hashed, values outside the candidates all as one other value.

    The candidates are at most k * 2^step literals. Reports meet them by their arrays' filter, then combine.
    """
    m: Mechanism = lh_half(eps, len(candidates) + 1)
    low = F.col(value).bitwiseAND(F.lit((1 << shift) - 1))
    inside = users.withColumn("_x", F.when(low.isin(candidates), low).otherwise(F.lit(1 << shift)))
    sent = perturb(inside, key, "_x", m, salt)
    cand = F.array(*(F.lit(c).cast("long") for c in candidates))
    seen = F.concat(F.array(F.lit(-1).cast("long")), F.filter(cand, lambda v: supports(m, v)))
    counts = sent.select(F.explode(seen).alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    d = sent.sparkSession.createDataFrame([(c,) for c in [-1, *candidates]], "v long").join(counts, "v", "left")
    d = d.withColumn("n", F.coalesce(F.max(F.when(F.col("v") == -1, F.col("c"))).over(whole()), F.lit(0))).withColumn("c", F.coalesce("c", F.lit(0)))
    return d.where("v >= 0").select("v", "c", "n", tidy(m.estimate(F.col("c"), F.col("n"))).alias("est"))


def find(users: DataFrame, key: str, value: str, bits: int, k: int, eps: float, step: int = 1, salt: str = "m") -> DataFrame:
    """v, est: the k most frequent values found, scaled to all users. Each round collects k candidates only."""
    first, t = rounds(bits, k, step)
    total = users.count()
    grouped = users.withColumn("_g", u32(key, salt + "g") % t)
    have = int(math.log2(k))
    cand = list(range(k))
    for i in range(t):
        shift = min(bits, first + i * step)
        cand = extended(cand, have, shift)
        got = round_estimate(grouped.where(F.col("_g") == i), key, value, cand, shift, eps, f"{salt}{i}")
        top = got.orderBy(F.desc("est"), "v").limit(k)
        if i == t - 1:
            return top.select("v", tidy(F.col("est") * F.lit(float(total)) / F.col("n")).alias("est"))
        cand, have = [r["v"] for r in top.collect()], shift


def hits(found: DataFrame, truth: DataFrame) -> DataFrame:
    """n, mass: how many found values are among the true ones (v, count), and their true count."""
    both = found.select("v").join(truth, "v")
    return both.agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("mass"))


def true_top(users: DataFrame, value: str, k: int) -> DataFrame:
    return users.groupBy(F.col(value).alias("v")).count().orderBy(F.desc("count"), "v").limit(k)
