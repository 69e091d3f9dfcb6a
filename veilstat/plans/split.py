"""Reports of a few attributes each: every user sends one report per part of the attributes, with a part of the budget.

A group is a way to part the attributes into reports of at most `size`, and a layer for each attribute. The estimate of
a node combination is, per group that has its layers, the sum over users of the product over reports of
(match - q) / (p - q), scaled to all users, and the mean over those groups. size = 1 has a report for each attribute,
size = all of them one joint report.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions.mechanisms import Mechanism, adaptive
from veilstat.functions.rng import cut, hash_params, hashed, u32
from veilstat.operators.randomize import keep_or_flip

from .hierarchy import Tree
from .query import Query


@dataclass(frozen=True)
class Group:
    gid: int
    parts: tuple[tuple[int, ...], ...]
    layers: tuple[int, ...]
    mechanisms: tuple[Mechanism, ...]


def partings(n: int, size: int) -> list[tuple[tuple[int, ...], ...]]:
    """The ways to part n attributes into as few reports of at most `size` as there can be."""
    fewest = -(-n // size)

    def grow(i: int, parts: list[list[int]]):
        if i == n:
            if len(parts) == fewest:
                yield tuple(tuple(p) for p in parts)
            return
        for p in parts:
            if len(p) < size:
                p.append(i)
                yield from grow(i + 1, parts)
                p.pop()
        if len(parts) < fewest:
            parts.append([i])
            yield from grow(i + 1, parts)
            parts.pop()

    return list(grow(0, []))


def groups(trees: list[Tree], eps: float, size: int, style: str = "rl") -> list[Group]:
    """All partings with all layer vectors; a group with a report on root layers only is left out."""
    vectors = [tuple(t.height - 1 for t in trees)] if style == "bl" else list(product(*(range(t.height) for t in trees)))
    out: list[Group] = []
    for parts in partings(len(trees), size):
        for v in vectors:
            if any(not any(v[i] for i in p) for p in parts):
                continue
            ms = tuple(adaptive(eps / len(parts), prod(len(trees[i].layers[v[i]]) for i in p)) for p in parts)
            out.append(Group(len(out), parts, v, ms))
    return out


def _multiplier(trees: list[Tree], g: Group, attr: int) -> tuple[int, int]:
    """The report of an attribute, and what its node counts for in the report's code."""
    r = next(j for j, p in enumerate(g.parts) if attr in p)
    after = g.parts[r][g.parts[r].index(attr) + 1 :]
    return r, prod(len(trees[i].layers[g.layers[i]]) for i in after)


def reports(users: DataFrame, uid: str, trees: list[Tree], plan: list[Group], salt: str = "k") -> DataFrame:
    """measure, gid and y_j, a_j, b_j for each report."""
    rows, most = [], max(len(g.parts) for g in plan)
    for g in plan:
        maps: list = []
        for i, t in enumerate(trees):
            r, m = _multiplier(trees, g, i)
            maps += [r, [x * m for x in t.places(g.layers[i])]]
        ms = [(int(m.hashes), m.size, cut(m.keep)) for m in g.mechanisms] + [(0, 2, 0)] * (most - len(g.mechanisms))
        rows.append((g.gid, *maps, *(x for m in ms for x in m)))
    shape = "gid long, " + ", ".join(f"r_{t.attr} int, at_{t.attr} array<long>" for t in trees) + ", " + ", ".join(f"lh_{j} int, size_{j} long, keep_{j} long" for j in range(most))
    d = users.withColumn("gid", u32(uid, salt + "g") % len(plan))
    d = d.join(F.broadcast(users.sparkSession.createDataFrame(rows, shape)), "gid")
    out = ["measure", "gid"]
    for j in range(most):
        code = F.lit(0).cast("long")
        for t in trees:
            code = code + F.when(F.col(f"r_{t.attr}") == j, F.element_at(f"at_{t.attr}", (F.col(t.attr) + 1).cast("int"))).otherwise(0)
        key = F.concat_ws(":", F.col(uid).cast("string"), F.col("gid").cast("string"))
        a, b = hash_params(key, f"{salt}{j}")
        d = d.withColumn(f"a_{j}", a).withColumn(f"b_{j}", b)
        x = F.when(F.col(f"lh_{j}") == 1, hashed(f"a_{j}", f"b_{j}", code, F.col(f"size_{j}"))).otherwise(code)
        d = d.withColumn(f"y_{j}", keep_or_flip(x, key, f"{salt}{j}", F.col(f"keep_{j}"), F.col(f"size_{j}")))
        out += [f"y_{j}", f"a_{j}", f"b_{j}"]
    return d.select(*out)


def estimate(sent: DataFrame, queries: list[Query], trees: list[Tree], plan: list[Group], style: str = "rl") -> DataFrame:
    """query, measure, est, all queries in one pass: reports meet the nodes of their group, patterns are counted.

    Node combinations whose layers no group has (all attributes of some report unasked in every parting) are estimated
    as the sum over their children.
    """
    by: dict[tuple[int, ...], list[Group]] = {}
    for g in plan:
        by.setdefault(g.layers, []).append(g)
    most = max(len(g.parts) for g in plan)
    rows = []

    def place(i: int, combo) -> None:
        own = by.get(tuple(n.layer for n in combo))
        if not own:
            k = min((j for j, n in enumerate(combo) if n.layer < trees[j].height - 1), key=lambda j: combo[j].layer)
            for n in trees[k].layers[combo[k].layer + 1]:
                if combo[k].lo <= n.lo and n.hi <= combo[k].hi:
                    place(i, (*combo[:k], n, *combo[k + 1 :]))
            return
        for g in own:
            codes = [0] * most
            for a, n in enumerate(combo):
                r, m = _multiplier(trees, g, a)
                codes[r] += n.idx * m
            ms = [(int(m.hashes), m.size, m.q, 1 / (m.p - m.q)) for m in g.mechanisms] + [(2, 2, 0.0, 1.0)] * (most - len(g.mechanisms))
            rows.append((i, g.gid, 1 / len(own), *(x for c, m in zip(codes, ms) for x in (c, *m))))

    for i, q in enumerate(queries):
        covers = [t.cover(*q.box.get(t.attr, (0, t.size)), first=t.height - 1 if style == "bl" else 0) for t in trees]
        for combo in product(*covers):
            place(i, combo)
    shape = "query int, gid long, share double, " + ", ".join(f"c_{j} long, lh_{j} int, size_{j} long, q_{j} double, s_{j} double" for j in range(most))
    d = sent.join(F.broadcast(sent.sparkSession.createDataFrame(rows, shape)), "gid")
    weight = F.col("share")
    for j in range(most):
        hit = F.when(F.col(f"lh_{j}") == 2, True).when(F.col(f"lh_{j}") == 1, hashed(f"a_{j}", f"b_{j}", f"c_{j}", F.col(f"size_{j}")) == F.col(f"y_{j}")).otherwise(F.col(f"c_{j}") == F.col(f"y_{j}"))
        weight = weight * (hit.cast("double") - F.col(f"q_{j}")) * F.col(f"s_{j}")
    per = sent.groupBy("measure", "gid").agg(F.count("*").alias("ng"))
    all_ = per.groupBy("measure").agg(F.sum("ng").alias("n"))
    sums = d.groupBy("query", "measure", "gid").agg(F.sum(weight).alias("w")).join(per, ["measure", "gid"]).join(all_, "measure")
    return sums.groupBy("query", "measure").agg(F.sum(F.col("w") * F.col("n") / F.col("ng")).alias("est"))
