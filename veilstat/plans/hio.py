"""Multi-dimensional range and point queries over hierarchies: user groups, joint reports, estimates.

Each group of users reports, for one layer of every attribute's tree, the combined node of its codes. A query becomes
the combinations of the nodes that cover its box; each combination is estimated from the group that reports its layers.
Style rl parts the users over all layer vectors, al lets every user report all of them with a split budget, bl has the
bottom layers only. The measure is public, so estimates are made per measure value.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.functions.mechanisms import Mechanism, adaptive
from veilstat.functions.rng import cut, hash_params, hashed, u32
from veilstat.operators.aggregate import tidy
from veilstat.operators.randomize import keep_or_flip

from .hierarchy import Tree
from .query import Query


@dataclass(frozen=True)
class Group:
    gid: int
    layers: tuple[int, ...]
    sizes: tuple[int, ...]
    mechanism: Mechanism


def groups(trees: list[Tree], eps: float, style: str = "rl") -> list[Group]:
    """Layer vectors without the all-root one, each with the mechanism of less variance for its joint domain."""
    if style == "bl":
        vectors = [tuple(t.height - 1 for t in trees)]
    else:
        vectors = [v for v in product(*(range(t.height) for t in trees)) if any(v)]
    budget = eps / len(vectors) if style == "al" else eps
    out = []
    for i, v in enumerate(vectors):
        sizes = tuple(len(t.layers[k]) for t, k in zip(trees, v))
        out.append(Group(i, v, sizes, adaptive(budget, prod(sizes))))
    return out


def config(users: DataFrame, trees: list[Tree], plan: list[Group]) -> DataFrame:
    """One row per group: its mechanism, and for each attribute the node of each code. A planner's table, broadcast."""
    rows = [(g.gid, int(g.mechanism.hashes), g.mechanism.size, cut(g.mechanism.keep), *([i * prod(g.sizes[k + 1 :]) for i in t.places(layer)] for k, (t, layer) in enumerate(zip(trees, g.layers)))) for g in plan]
    shape = "gid long, lh int, size long, keep long, " + ", ".join(f"at_{t.attr} array<long>" for t in trees)
    return users.sparkSession.createDataFrame(rows, shape)


def reports(users: DataFrame, uid: str, trees: list[Tree], plan: list[Group], style: str = "rl", salt: str = "h") -> DataFrame:
    """measure, gid, y, a, b of users(uid, measure, a code per attribute); narrow but for the broadcast of the groups."""
    if style == "al":
        d = users.withColumn("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(plan) - 1).cast("long"))))
    else:
        d = users.withColumn("gid", u32(uid, salt + "g") % len(plan))
    d = d.join(F.broadcast(config(users, trees, plan)), "gid")
    d = d.withColumn("code", sum((F.element_at(f"at_{t.attr}", (F.col(t.attr) + 1).cast("int")) for t in trees), F.lit(0).cast("long")))
    key = F.concat_ws(":", F.col(uid).cast("string"), F.col("gid").cast("string"))
    a, b = hash_params(key, salt)
    d = d.withColumn("a", a).withColumn("b", b)
    x = F.when(F.col("lh") == 1, hashed("a", "b", "code", F.col("size"))).otherwise(F.col("code"))
    return d.select("measure", "gid", keep_or_flip(x, key, salt, F.col("keep"), F.col("size")).alias("y"), "a", "b")


def nodes(queries: list[Query], trees: list[Tree], plan: list[Group], style: str = "rl") -> list[tuple[int, int, int]]:
    """(query, gid, code) of every node combination; gid -1 stands for all users."""
    by = {g.layers: g for g in plan}
    out = []
    for i, q in enumerate(queries):
        covers = []
        for t in trees:
            bottom = t.height - 1 if style == "bl" else 0
            box = q.box.get(t.attr)
            covers.append(t.cover(*(box or (0, t.size)), first=bottom))
        for combo in product(*covers):
            layers = tuple(n.layer for n in combo)
            if not any(layers):
                out.append((i, -1, 0))
                continue
            g, code = by[layers], 0
            for n, size in zip(combo, by[layers].sizes):
                code = code * size + n.idx
            out.append((i, g.gid, code))
    return out


def volume(queries: list[Query], trees: list[Tree]) -> list[int]:
    """Node combinations of each query."""
    return [prod(len(t.cover(*q.box.get(t.attr, (0, t.size)))) for t in trees) for q in queries]


def estimate(sent: DataFrame, queries: list[Query], trees: list[Tree], plan: list[Group], style: str = "rl") -> DataFrame:
    """query, measure, est: unbiased number of users in each query's box, per measure value; all queries in one pass.

    Reports meet the nodes of their group in a broadcast join; only counts per query, measure and group are shuffled.
    Groups of unequal size are scaled by their own share of the users with the measure value.
    """
    spark = sent.sparkSession
    asked = nodes(queries, trees, plan, style)
    table = spark.createDataFrame([(i, g, c) for i, g, c in asked if g >= 0] or [(-1, -1, 0)], "query int, gid long, code long")
    params = spark.createDataFrame([(g.gid, int(g.mechanism.hashes), g.mechanism.size, g.mechanism.p, g.mechanism.q) for g in plan], "gid long, lh int, size long, p double, q double")
    table = table.join(F.broadcast(params), "gid")
    hit = F.when(F.col("lh") == 1, hashed("a", "b", "code", F.col("size")) == F.col("y")).otherwise(F.col("code") == F.col("y"))
    counts = sent.join(F.broadcast(table), "gid").groupBy("query", "measure", "gid", "p", "q").agg(F.sum(hit.cast("long")).alias("c"), F.count("*").alias("pairs"))
    per = sent.groupBy("measure", "gid").agg(F.count("*").alias("ng"))
    total = F.max("ng") if style == "al" else F.sum("ng")
    all_ = per.groupBy("measure").agg(total.alias("n"))
    est = counts.join(per, ["measure", "gid"]).join(all_, "measure")
    part = (F.col("c") - F.col("pairs") * F.col("q")) / (F.col("p") - F.col("q")) * F.col("n") / F.col("ng")
    got = est.select("query", "measure", part.alias("est"))
    whole = [i for i, g, _ in asked if g < 0]
    if whole:
        got = got.unionByName(all_.select(F.explode(F.array(*(F.lit(i) for i in whole))).alias("query"), "measure", F.col("n").cast("double").alias("est")))
    return got.groupBy("query", "measure").agg(F.sum("est").alias("est"))


def estimate_all(sent: DataFrame, plan: list[Group], style: str = "rl") -> DataFrame:
    """measure, gid, code, est of every cell of every group: the tables that any later query can be answered from."""
    spark = sent.sparkSession
    rows = [(g.gid, int(g.mechanism.hashes), g.mechanism.size, g.mechanism.p, g.mechanism.q, prod(g.sizes)) for g in plan]
    params = spark.createDataFrame(rows, "gid long, lh int, size long, p double, q double, cells long")
    d = sent.join(F.broadcast(params), "gid")
    every = F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
    seen = F.when(F.col("lh") == 1, F.filter(every, lambda v: hashed("a", "b", v, F.col("size")) == F.col("y"))).otherwise(F.array("y"))
    counts = d.select("measure", "gid", F.explode(seen).alias("code")).groupBy("measure", "gid", "code").agg(F.count("*").alias("c"))
    per = sent.groupBy("measure", "gid").agg(F.count("*").alias("ng"))
    total = F.max("ng") if style == "al" else F.sum("ng")
    full = per.join(per.groupBy("measure").agg(total.alias("n")), "measure").join(F.broadcast(params), "gid").withColumn("code", F.explode(every))
    got = full.join(counts, ["measure", "gid", "code"], "left")
    est = (F.coalesce("c", F.lit(0)) - F.col("ng") * F.col("q")) / (F.col("p") - F.col("q")) * F.col("n") / F.col("ng")
    return got.select("measure", "gid", "code", est.alias("est"))


def lookup(table: DataFrame, queries: list[Query], trees: list[Tree], plan: list[Group], style: str = "rl") -> DataFrame:
    """query, measure, est from the cells of estimate_all(); a query for all users needs none and is left out."""
    asked = table.sparkSession.createDataFrame([x for x in nodes(queries, trees, plan, style) if x[1] >= 0], "query int, gid long, code long")
    return table.join(F.broadcast(asked), ["gid", "code"]).groupBy("query", "measure").agg(F.sum("est").alias("est"))


def answers(users: DataFrame, uid: str, queries: list[Query], trees: list[Tree], eps: float, style: str = "rl", weight: Column | None = None, salt: str = "h") -> DataFrame:
    """query, count, sum, avg: estimates of COUNT, SUM of the weighted measure, and SUM / COUNT."""
    plan = groups(trees, eps, style)
    sent = reports(users, uid, trees, plan, style, salt)
    w = weight if weight is not None else F.col("measure")
    summed = estimate(sent, queries, trees, plan, style).groupBy("query").agg(F.sum(w * F.col("est")).alias("sum"))
    counted = estimate(sent.withColumn("measure", F.lit(0)), queries, trees, plan, style).select("query", F.col("est").alias("count"))
    both = summed.join(counted, "query")
    return both.select("query", tidy(F.col("count")).alias("count"), tidy(F.col("sum")).alias("sum"), tidy(F.when(F.col("count") != 0, F.col("sum") / F.col("count"))).alias("avg"))


def in_box(q: Query) -> Column:
    """Whether a user's codes are in a query's box."""
    out = F.lit(True)
    for name, (lo, hi) in q.box.items():
        out = out & (F.col(name) >= lo) & (F.col(name) < hi)
    return out


def exact(users: DataFrame, queries: list[Query], weight: Column | None = None) -> DataFrame:
    """query, count, sum, avg, selectivity without noise, all queries as conditional sums of one scan."""
    w = weight if weight is not None else F.col("measure")
    aggs = [F.count("*").alias("n")]
    for i, q in enumerate(queries):
        aggs += [F.sum(in_box(q).cast("long")).alias(f"c{i}"), F.sum(F.when(in_box(q), w).otherwise(0)).alias(f"s{i}")]
    one = users.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(i).alias("query"), F.col(f"c{i}").alias("count"), F.col(f"s{i}").cast("double").alias("sum")) for i in range(len(queries))))
    d = one.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    return d.select("query", "count", "sum", tidy(F.col("sum") / F.col("count")).alias("avg"), tidy(F.col("count") / F.col("n")).alias("selectivity"))


def separate_reports(users: DataFrame, uid: str, trees: list[Tree], eps: float, salt: str = "q") -> DataFrame:
    """One report per attribute on its leaves, each with an equal part of the budget: y_i, a_i, b_i."""
    d = users
    for i, t in enumerate(trees):
        m = adaptive(eps / len(trees), t.size)
        a, b = hash_params(uid, f"{salt}{i}")
        d = d.withColumn(f"a_{i}", a).withColumn(f"b_{i}", b)
        x = hashed(f"a_{i}", f"b_{i}", t.attr, m.size) if m.hashes else F.col(t.attr)
        d = d.withColumn(f"y_{i}", keep_or_flip(x, uid, f"{salt}{i}", cut(m.keep), m.size))
    return d.select("measure", *(f"{c}_{i}" for i in range(len(trees)) for c in "yab"))


def joint_cells(sent: DataFrame, trees: list[Tree], eps: float, cells: list[tuple[int, ...]]) -> DataFrame:
    """cell, est: users in each cell of joint codes, from separate reports.

    Per cell the reports are counted by which attributes match (2^attributes counts); each pattern then weighs as the
    product over its attributes of (match - q) / (p - q), which equals inclusion and exclusion over subsets.
    """
    ms = [adaptive(eps / len(trees), t.size) for t in trees]
    table = sent.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(cells)], "cell int, " + ", ".join(f"v_{i} long" for i in range(len(trees))))
    bits, weight = F.lit(0), F.lit(1.0)
    for i, m in enumerate(ms):
        hit = hashed(f"a_{i}", f"b_{i}", f"v_{i}", m.size) == F.col(f"y_{i}") if m.hashes else F.col(f"y_{i}") == F.col(f"v_{i}")
        bits = bits + hit.cast("int") * (1 << i)
        weight = weight * ((F.floor(F.col("bits") / (1 << i)) % 2 - F.lit(m.q)) / F.lit(m.p - m.q))
    counts = sent.crossJoin(F.broadcast(table)).groupBy("cell", bits.alias("bits")).agg(F.count("*").alias("c"))
    return counts.groupBy("cell").agg(tidy(F.sum(F.col("c") * weight)).alias("est"))
