"""Marginals: of a joint estimate by summing out, and of user groups that each report one view of a few attributes."""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions.mechanisms import ue
from veilstat.functions.rng import cut, u32

from .aggregate import tidy
from .randomize import combine, split


def all_marginals(joint: DataFrame, attrs: list[str], sizes: list[int]) -> DataFrame:
    """attrs (null where summed out), est of every subset of attributes, from joint(v, est): one cube."""
    d = joint.select(*(c.alias(a) for a, c in zip(attrs, split("v", sizes))), "est")
    return d.cube(*attrs).agg(tidy(F.sum("est")).alias("est"))


def view_counts(users: DataFrame, uid: str, views: list[list[str]], sizes: dict[str, int], eps: float, salt: str = "v") -> DataFrame:
    """view, v, c, n: set bits per cell of each view, from unary reports of the users of that view, and their number.

    A user's view is a hash of the key, so views share no users. Reports exist as set bits only and combine at once.
    """
    q = 1 / (_e(eps) + 1)
    d = users.withColumn("view", u32(uid, salt + "g") % len(views))
    code, size = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, view in enumerate(views):
        code = F.when(F.col("view") == i, combine(view, [sizes[a] for a in view])).otherwise(code)
        size = F.when(F.col("view") == i, prod(sizes[a] for a in view)).otherwise(size)
    d = d.select(F.col(uid).alias("uid"), "view", code.alias("code"), size.cast("long").alias("size"))
    d = d.withColumn("v", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("size") - 1)))
    bit = u32(F.concat_ws(":", F.col("uid").cast("string"), F.col("v").cast("string")), salt + "u")
    set_ = (F.col("v") < 0) | (bit < F.when(F.col("v") == F.col("code"), cut(0.5)).otherwise(cut(q)))
    counts = d.where(set_).groupBy("view", "v").agg(F.count("*").alias("c"))
    n = counts.where("v = -1").select("view", F.col("c").alias("n"))
    return counts.where("v >= 0").join(F.broadcast(n), "view")


def _e(eps: float) -> float:
    import math

    return math.exp(eps)


def view_query(counts: DataFrame, views: list[list[str]], sizes: dict[str, int], box: dict[str, tuple[int, int]], eps: float) -> DataFrame:
    """view, share of a box in each view: its cells summed; attributes that a view lacks count as uniform."""
    m = ue(eps, 2)
    rows = None
    for i, view in enumerate(views):
        d = counts.where(F.col("view") == i)
        for a, c in zip(view, split("v", [sizes[x] for x in view])):
            lo, hi = box.get(a, (0, sizes[a]))
            d = d.where((c >= lo) & (c < hi))
        cells = prod(box.get(a, (0, sizes[a]))[1] - box.get(a, (0, sizes[a]))[0] for a in view)
        rest = 1.0
        for a, (lo, hi) in box.items():
            if a not in view:
                rest *= (hi - lo) / sizes[a]
        got = d.groupBy("view").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
        got = got.select("view", ((F.col("c") / F.col("n") - F.lit(cells * m.q)) / F.lit(m.p - m.q) * F.lit(rest)).alias("share"))
        rows = got if rows is None else rows.unionByName(got)
    return rows


def pairs(attrs: list[str]) -> list[list[str]]:
    return [list(x) for x in combinations(attrs, 2)]
