"""Randomness as a pure function of a row's key and a salt, so that every operator can be checked exactly.

A public salt gives no privacy: collect real data with a secret salt of your own (it is part of every salt argument).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of the hash family ((a * v + b) % PRIME) % g.
PRIME = 2_147_483_647


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def u32(key: Column | str, salt: str) -> Column:
    """A uniform integer in [0, 2^32)."""
    return F.conv(F.substring(F.md5(F.concat(col(key).cast("string"), F.lit(":" + salt))), 1, 8), 16, 10).cast("long")


def cut(p: float) -> int:
    """The integer below which u32 falls with probability p."""
    return int(p * 2**32)


def unit(key: Column | str, salt: str) -> Column:
    """A uniform double in [0, 1)."""
    return u32(key, salt) / F.lit(4294967296.0)


def hash_params(key: Column | str, salt: str) -> tuple[Column, Column]:
    """a in [1, PRIME - 1] and b in [0, PRIME - 1] of one report's hash function."""
    return u32(key, salt + "a") % (PRIME - 1) + 1, u32(key, salt + "b") % PRIME


def hashed(a: Column | str, b: Column | str, v: Column | str, g) -> Column:
    """The hash of a code v < 2^31 into [0, g); stays below 2^62."""
    return ((col(a) * col(v) + col(b)) % PRIME) % g
