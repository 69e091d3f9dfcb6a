"""Parameters of frequency oracles, and what follows from them: probabilities, variances, choices between them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mechanism:
    """p, q: chance that a report supports its own and another value; size: values that a report can take."""

    kind: str
    eps: float
    d: int
    size: int
    p: float
    q: float

    @property
    def hashes(self) -> bool:
        return self.kind in ("lh", "olh", "lh_half")

    @property
    def keep(self) -> float:
        return self.p

    @property
    def variance(self) -> float:
        """Of one report's contribution to an estimate."""
        if self.kind == "grr":
            return self.q * (1 - self.q) / (self.p - self.q) ** 2
        e = math.exp(self.eps)
        return 4 * e / (e - 1) ** 2

    def estimate(self, count: Column, n: Column) -> Column:
        """Unbiased number of users with a value, from its support among n reports."""
        if self.kind == "olh":
            return (self.size * count - n) / F.lit(self.p * self.size - 1)
        return (count - n * F.lit(self.q)) / F.lit(self.p - self.q)

    def observed(self, est: Column, n) -> Column:
        """The support that an estimate stands for."""
        return est * F.lit(self.p - self.q) + n * F.lit(self.q)


def grr(eps: float, d: int) -> Mechanism:
    e = math.exp(eps)
    return Mechanism("grr", eps, d, d, e / (e + d - 1), 1 / (e + d - 1))


def lh(eps: float, d: int) -> Mechanism:
    e = math.exp(eps)
    g = round(e) + 1
    return Mechanism("lh", eps, d, g, e / (e + g - 1), 1 / g)


def olh(eps: float, d: int) -> Mechanism:
    """The same reports as lh; its estimate is written (g C - n) / (p g - 1)."""
    return replace(lh(eps, d), kind="olh")


def lh_half(eps: float, d: int) -> Mechanism:
    """Keeps with one half, over floor(e^eps) + 1 hash values."""
    g = int(math.exp(eps)) + 1
    return Mechanism("lh_half", eps, d, g, 0.5, 1 / g)


def ue(eps: float, d: int) -> Mechanism:
    return Mechanism("ue", eps, d, 2, 0.5, 1 / (math.exp(eps) + 1))


def adaptive(eps: float, d: int) -> Mechanism:
    """Local hashing where it has the smaller variance, else randomised response."""
    return lh(eps, d) if d > 3 * math.exp(eps) + 2 else grr(eps, d)


def noise_floor(m: Mechanism, n: int, alpha: float = 0.05) -> float:
    """What an estimate over m.d values must exceed not to be noise, at level alpha over all of them."""
    return NormalDist().inv_cdf(1 - alpha / m.d) * math.sqrt(n * m.variance)


def amplified(eps: float, candidates: int, length: int) -> tuple[bool, float]:
    """Whether sampling one of `length` items favours randomised response, and the budget that it then may use."""
    if candidates < length * math.exp(eps) * (4 * length - 1) + 1:
        return True, math.log(length * (math.exp(eps) - 1) + 1)
    return False, eps


@dataclass(frozen=True)
class SquareWave:
    eps: float

    @property
    def w(self) -> float:
        e, x = math.exp(self.eps), self.eps
        return 2 * (x * e - e + 1) / (2 * e * (e - 1 - x))

    @property
    def p(self) -> float:
        return math.exp(self.eps) * self.q

    @property
    def q(self) -> float:
        return 1 / (self.w * math.exp(self.eps) + 1)
