"""Client side: one report per user from a value, all in narrow projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstat.functions.mechanisms import Mechanism, SquareWave
from veilstat.functions.rng import PRIME, col, cut, hash_params, hashed, u32, unit


def keep_or_flip(x: Column, key: Column | str, salt: str, keep: Column | int, size: Column | int) -> Column:
    """x where the key's draw is below keep (of 2^32), else uniform over the other size - 1 values."""
    z = u32(key, salt + "z") % (size - 1)
    return F.when(u32(key, salt + "u") < keep, x).otherwise(F.when(z >= x, z + 1).otherwise(z))


def perturb(users: DataFrame, key: Column | str, value: Column | str, m: Mechanism, salt: str = "r") -> DataFrame:
    """users with y (and a, b of the report's hash function); unary encoding gives a row per set bit, with y its place.

    A report depends on nothing but key, value and salt. Values are codes in [0, d); null values give no report.
    """
    d = users.withColumn("_v", col(value).cast("long")).where("_v is not null")
    if m.kind == "ue":
        d = d.withColumn("y", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(m.d - 1).cast("long"))))
        bit = u32(F.concat_ws(":", col(key).cast("string"), F.col("y").cast("string")), salt + "u")
        return d.where((F.col("y") < 0) | (bit < F.when(F.col("y") == F.col("_v"), cut(m.p)).otherwise(cut(m.q)))).drop("_v")
    if m.kind == "grr":
        return d.withColumn("y", keep_or_flip(F.col("_v"), key, salt, cut(m.p), m.size)).drop("_v")
    a, b = hash_params(key, salt)
    d = d.withColumn("a", a).withColumn("b", b)
    return d.withColumn("y", keep_or_flip(hashed("a", "b", "_v", m.size), key, salt, cut(m.p), m.size)).drop("_v")


def square_wave(users: DataFrame, key: Column | str, value: Column | str, sw: SquareWave, salt: str = "s") -> DataFrame:
    """users with y in [-w/2, 1 + w/2] from values in [0, 1]: near the value with density p, elsewhere with q."""
    u, s = unit(key, salt), col(value)
    w, p, q = F.lit(sw.w), F.lit(sw.p), F.lit(sw.q)
    y = F.when(u <= q * s, u / q - w / 2).when(u <= q * s + p * w, (u - q * s) / p + s - w / 2).otherwise((u - q * s - p * w) / q + s + w / 2)
    return users.withColumn("y", y)


def combine(codes: list[Column | str], sizes: list[int]) -> Column:
    """One code for several, the last changing fastest."""
    out = F.lit(0).cast("long")
    for c, n in zip(codes, sizes):
        out = out * n + col(c)
    return out


def split(code: Column | str, sizes: list[int]) -> list[Column]:
    """The codes that combine() made one."""
    out, rest = [], col(code)
    for n in reversed(sizes):
        out.insert(0, (rest % n).cast("long"))
        rest = F.floor(rest / n).cast("long")
    return out


def sample_item(key: Column | str, items: Column | str, salt: str = "i") -> Column:
    """A uniform item of a list, null if it is empty."""
    n = F.size(items)
    return F.when(n > 0, F.element_at(items, (u32(key, salt) % F.greatest(n, F.lit(1)) + 1).cast("int")))


def pad_and_sample(key: Column | str, items: Column | str, candidates: Column, length: int, dummy: int, salt: str = "p") -> Column:
    """A uniform place of the candidate items padded to `length`; a padded place is the dummy, longer lists are not cut."""
    own = F.array_sort(F.array_intersect(col(items), candidates))
    at = u32(key, salt) % F.greatest(F.size(own), F.lit(length))
    return F.when(at < F.size(own), F.element_at(own, (at + 1).cast("int"))).otherwise(F.lit(dummy))


def add_fakes(reports: DataFrame, column: str, n: int, d: int, salt: str = "f") -> DataFrame:
    """Reports and n uniform fake ones over [0, d)."""
    fakes = reports.sparkSession.range(n).select((u32(F.col("id"), salt) % d).alias(column))
    return reports.select(F.col(column).cast("long").alias(column)).unionByName(fakes)


__all__ = ["PRIME", "add_fakes", "combine", "keep_or_flip", "pad_and_sample", "perturb", "sample_item", "split", "square_wave"]
