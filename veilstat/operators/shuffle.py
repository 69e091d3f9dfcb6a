"""Shuffle model: privacy after mixing reports of many users, its inversion, and the choice of mechanism and fakes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.functions.mechanisms import grr
from veilstat.functions.rng import u32

from .aggregate import histogram, tidy
from .randomize import add_fakes, perturb


def _level(delta: float) -> float:
    return 14 * math.log(2 / delta)


def blanket(coefficient, others) -> Column:
    return F.sqrt(coefficient / others)


def central_grr(e0: Column, delta: float, n: Column, d: Column, fakes: Column | None = None) -> Column:
    """Privacy of shuffled randomised response over d values, with fakes mixed in."""
    more = fakes / d if fakes is not None else F.lit(0.0)
    return blanket(F.lit(_level(delta)), (n - 1) / (F.exp(e0) + d - 1) + more)


def central_hash(e0: Column, delta: float, n: Column) -> Column:
    d = F.rint(F.exp(e0 / 2) + 1)
    return blanket(F.lit(4 * _level(delta)), (n - 1) / (F.exp(e0) + d - 1))


def central_fakes(delta: float, fakes: Column, d: Column) -> Column:
    """From the fakes alone."""
    return blanket(F.lit(_level(delta)), fakes / d)


def _log_or(x: Column, out: Column) -> Column:
    return F.when(x > 1, out).otherwise(-1.0)


def local_grr(ec: Column, delta: float, n: Column, d: Column) -> Column:
    """The local budget that shuffling turns into ec, or -1."""
    x = ec * ec * (n - 1) / _level(delta) - d + 1
    return _log_or(x, F.log(x))


def local_hash(ec: Column, delta: float, n: Column) -> Column:
    x = ec * ec / 4 * (n - 1) / _level(delta) - 1
    return _log_or(x, 2 * F.log(x))


def local_grr_fakes(ec: Column, delta: float, n: Column, d: Column, fakes: Column) -> Column:
    t = (n - 1) / (_level(delta) / (ec * ec) - fakes / d) - (d - 1)
    return _log_or(t, F.log(t))


def local_hash_fakes(ec: Column, delta: float, n: Column, fakes: Column) -> Column:
    t = ec * ec * (n - 1 + fakes) / (4 * _level(delta)) - 1
    return _log_or(t, 2 * F.log(t))


def variance(e0: Column, n: Column, d: Column, full: Column, fakes: Column) -> Column:
    """Of one frequency, for response over d values (the full domain, or a hashed one) with fakes."""
    bottom = F.exp(e0) + d - 1
    p = F.exp(e0) / bottom
    q = F.when(d == full, 1 / bottom).otherwise(1 / d)
    p2 = q + (p - q) / d
    return (n * q * (1 - q) + n / d * (p * (1 - p) - q * (1 - q)) + fakes * p2 * (1 - p2)) / n / n / F.pow(p - q, F.lit(2.0))


def choice(spark: SparkSession, ec: float, delta: float, n: int, d: int, fakes: int = 0) -> DataFrame:
    """mechanism, size, e0, var: response or hashing, whichever has less variance at ec; no shuffling gain: e0 = ec."""
    row = spark.range(1).select(F.lit(ec).alias("ec"), F.lit(float(n)).alias("n"), F.lit(float(d)).alias("d"), F.lit(float(fakes)).alias("fakes"))
    e1 = local_grr_fakes(F.col("ec"), delta, F.col("n"), F.col("d"), F.col("fakes"))
    e2 = local_hash_fakes(F.col("ec"), delta, F.col("n"), F.col("fakes"))
    both = row.select("ec", "n", "d", "fakes", F.explode(F.array(F.struct(F.lit("grr").alias("mechanism"), e1.alias("e0")), F.struct(F.lit("olh").alias("mechanism"), e2.alias("e0")))).alias("m")).select("ec", "n", "d", "fakes", "m.*")
    both = both.withColumn("gain", F.col("e0") > 0).withColumn("e0", F.greatest("e0", "ec"))
    both = both.withColumn("size", F.when(F.col("mechanism") == "grr", F.col("d")).otherwise(F.rint(F.exp(F.col("e0") / 2) + 1)))
    both = both.withColumn("var", variance(F.col("e0"), F.col("n"), F.col("size"), F.col("d"), F.col("fakes")))
    return both.orderBy(F.desc("gain"), "var", "mechanism").limit(1).select("mechanism", "size", "e0", "var")


def fake_grid(spark: SparkSession, ec: float, delta: float, n: int, d: int, points: int = 1000) -> DataFrame:
    """fakes, e0, var over numbers of fakes from 1000 to 2 n."""
    step = (2.0 * n - 1000.0) / (points - 1)
    g = spark.range(points).select((F.lit(1000.0) + F.col("id") * F.lit(step)).alias("fakes"))
    g = g.withColumn("e0", local_grr_fakes(F.lit(ec), delta, F.lit(float(n)), F.lit(float(d)), F.col("fakes")))
    return g.where("e0 > 0").withColumn("var", variance(F.col("e0"), F.lit(float(n)), F.lit(float(d)), F.lit(float(d)), F.col("fakes")))


def best_fakes(spark: SparkSession, ec: float, delta: float, n: int, d: int) -> DataFrame:
    return fake_grid(spark, ec, delta, n, d).orderBy("var", "fakes").limit(1)


def with_fakes(users: DataFrame, key: str, value: str, eps: float, d: int, fakes: int, salt: str = "mu") -> DataFrame:
    """v, est of randomised response after mixing in uniform fakes, less their even share."""
    m = grr(eps, d)
    real = users.select(F.concat(F.lit("u"), F.col(key).cast("string")).alias("k"), F.col(value).cast("long").alias("x"))
    more = users.sparkSession.range(fakes).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("k"), (u32(F.col("id"), salt + "f") % d).alias("x"))
    est = histogram(perturb(real.unionByName(more), "k", "x", m, salt), m)
    return est.select("v", tidy(F.col("est") - fakes / d).alias("est"))


def shuffled(reports: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Reports without their keys, in an order and partition that say nothing of who sent them."""
    n = reports.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return reports.select(*columns, F.rand(seed).alias("_o")).repartition(int(n), "_o").sortWithinPartitions("_o").drop("_o")


def sealed(reports: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The column encrypted in layers, the last key outermost: one layer for each hop that shuffles."""
    d = F.col(column).cast("string").cast("binary")
    for k in keys:
        d = F.aes_encrypt(d, F.lit(k), F.lit("GCM"))
    return reports.withColumn(column, d)


def opened(reports: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The same layers taken off."""
    d = F.col(column)
    for k in reversed(keys):
        d = F.aes_decrypt(d, F.lit(k), F.lit("GCM"))
    return reports.withColumn(column, d.cast("string"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["add_fakes"]
