"""Frequent itemsets of set-valued data: singletons, lengths, pad-and-sample, candidate sets, their estimates."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstat.functions.mechanisms import Mechanism, amplified, grr, lh_half
from veilstat.sources.tables import phased

from .aggregate import histogram, tidy, whole
from .randomize import pad_and_sample, perturb, sample_item

#: Shares of the users: singleton sample, length and estimate; itemset length and estimate.
PHASES = [0.16, 0.04, 0.20, 0.12, 0.48]


def phases(users: DataFrame, key: str, salt: str = "ph") -> DataFrame:
    return phased(users, key, PHASES, salt)


def singletons(users: DataFrame, key: str, items: str, d: int, eps: float, salt: str = "s1") -> DataFrame:
    """v, est over the dictionary from one uniform item of each user; users without items give none."""
    one = users.withColumn("_item", sample_item(key, items, salt + "i"))
    return histogram(perturb(one, key, "_item", lh_half(eps, d), salt), lh_half(eps, d))


def literal(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)) for v in values))


def lengths(users: DataFrame, key: str, size: Column, limit: int, eps: float, salt: str = "s2") -> DataFrame:
    """v, est for sizes 0..limit; users of size 0 are left out, larger sizes count as 0."""
    m = lh_half(eps, limit + 1)
    d = users.withColumn("_n", size).where("_n > 0").withColumn("_n", F.when(F.col("_n") > limit, 0).otherwise(F.col("_n")))
    return histogram(perturb(d, key, "_n", m, salt), m)


def candidate_size(items: str, candidates: list[int]) -> Column:
    return F.size(F.array_intersect(F.col(items).cast("array<int>"), literal(candidates)))


def percentile_length(dist: DataFrame, share: float = 0.9, most: int = 30) -> DataFrame:
    """length: the smallest size from 1 whose cumulated share passes `share`, at most `most`."""
    d = dist.where("v >= 1").withColumn("est", F.greatest("est", F.lit(0.0)))
    run = F.sum("est").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # one row per length
    d = d.withColumn("run", run).withColumn("total", F.sum("est").over(whole()))
    return d.agg(F.least(F.coalesce(F.min(F.when(F.col("run") > share * F.col("total"), F.col("v"))), F.lit(most)), F.lit(most)).cast("int").alias("length"))


def mechanism(eps: float, candidates: int, length: int) -> Mechanism:
    """Randomised response with the amplified budget where it has less variance, else local hashing; one value is the dummy."""
    small, budget = amplified(eps, candidates, length)
    return grr(budget, candidates + 1) if small else lh_half(eps, candidates + 1)


def padded(users: DataFrame, key: str, items: str, candidates: list[int], length: int, eps: float, salt: str = "s3") -> DataFrame:
    """item, est: estimates of candidate items from pad-and-sample reports, times the length, scaled to the phase."""
    m = mechanism(eps, len(candidates), length)
    pick = pad_and_sample(key, F.col(items).cast("array<int>"), literal(candidates), length, -1, salt + "p")
    code = F.coalesce(F.array_position(literal(candidates), pick).cast("long") - 1, F.lit(-1))
    d = users.withColumn("_c", F.when(code < 0, len(candidates)).otherwise(code))
    est = histogram(perturb(d, key, "_c", m, salt), m).where(F.col("v") < len(candidates))
    return est.select(F.element_at(literal(candidates), (F.col("v") + 1).cast("int")).alias("item"), tidy(F.col("est") * length).alias("est"))


def candidate_sets(weights: dict[int, float], k: int) -> list[tuple[int, ...]]:
    """The k sets of two items or more with the largest products of 0.9 * weight / largest weight; best first.

    A set grows by later items only, so each comes once, and a product only falls as its set grows.
    """
    top = max(weights.values(), default=0.0)
    if top <= 0:
        return []
    order = sorted(((0.9 * w / top, i) for i, w in weights.items() if w > 0), key=lambda x: (-x[0], x[1]))
    open_ = [(-p, (at,)) for at, (p, _) in enumerate(order)]
    heapq.heapify(open_)
    out: list[tuple[int, ...]] = []
    while open_ and len(out) < k:
        p, s = heapq.heappop(open_)
        if len(s) > 1:
            out.append(tuple(sorted(order[i][1] for i in s)))
        for nxt in range(s[-1] + 1, len(order)):
            heapq.heappush(open_, (p * order[nxt][0], (*s, nxt)))
    return out


def contained(items: str, sets: list[tuple[int, ...]]) -> Column:
    """The places of the sets that a user's items contain, as an array."""
    own = F.col(items).cast("array<int>")
    places = [F.when(F.size(F.array_intersect(own, literal(s))) == len(s), i) for i, s in enumerate(sets)]
    return F.array_compact(F.array(*places))


def find(users: DataFrame, key: str, items: str, d: int, k: int, eps: float, salt: str = "sv") -> DataFrame:
    """items (array), est: the k most frequent items and sets found. Between phases only candidates are collected."""
    p = phases(users, key, salt)
    n = users.count()
    part = [p.where(F.col("phase") == i) for i in range(5)]
    top = singletons(part[0], key, items, d, eps, salt + "1").orderBy(F.desc("est"), "v").limit(2 * k)
    cand = sorted(r["v"] for r in top.collect())
    length = percentile_length(lengths(part[1], key, candidate_size(items, cand), len(cand), eps, salt + "2")).first()[0]
    single = padded(part[2], key, items, cand, length, eps, salt + "3").orderBy(F.desc("est"), "item").limit(k)
    rows = [(r["item"], r["est"] * n / max(part[2].count(), 1)) for r in single.collect()]
    sets = candidate_sets(dict(rows), 2 * k)
    out = [([i], e) for i, e in rows]
    if sets:
        inside = users.sparkSession.createDataFrame
        own = part[3].withColumn("_sets", contained(items, sets))
        dist = {r["v"]: r["est"] for r in lengths(own, key, F.size("_sets"), len(sets), eps, salt + "4").collect()}
        most = percentile_length(inside([(int(v), float(e)) for v, e in dist.items()], "v long, est double")).first()[0]
        est = padded(part[4].withColumn("_sets", contained(items, sets)), key, "_sets", list(range(len(sets))), most, eps, salt + "5").collect()
        scale = n / max(part[4].count(), 1)
        total = sum(r["est"] for r in est)
        tail = 0.0
        for v in range(most + 1, len(sets) + 1):
            if dist.get(v, 0) <= 0:
                break
            tail += dist[v] * (v - most)
        ratio = 1 + tail / total if total > 0 else 1.0
        out += [(list(sets[r["item"]]), r["est"] * scale * ratio) for r in est]
    return users.sparkSession.createDataFrame(out, "items array<int>, est double").orderBy(F.desc("est"), "items").limit(k)
