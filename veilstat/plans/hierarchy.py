"""Range trees over codes, minimal covers of ranges, and the fanout with the least error: planning without data."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


def best_fanout(eps: float, m: int = 1024) -> int:
    """The fanout from 2 to m of least error when all levels are reported with split budget."""

    def error(b: int) -> float:
        h = math.log(m, b)
        e = math.exp(eps / h)
        return (b - 1) * h * e / (e - 1) ** 2

    return min(range(2, m + 1), key=error)


@dataclass(frozen=True)
class Node:
    layer: int
    idx: int
    lo: int
    hi: int


@dataclass(frozen=True)
class Tree:
    """An attribute's hierarchy: ordinal ones split each range into `fanout` parts, flat ones have a root and leaves."""

    attr: str
    size: int
    fanout: int = 0

    @cached_property
    def layers(self) -> list[list[Node]]:
        if not self.fanout:
            return [[Node(0, 0, 0, self.size)], [Node(1, i, i, i + 1) for i in range(self.size)]]
        depth = math.ceil(round(math.log(max(self.size - 1, 1), self.fanout), 9)) + 1
        out = [[Node(0, 0, 0, self.size)]]
        for layer in range(1, depth + 1):
            cuts = []
            for n in out[-1]:
                step = (n.hi - n.lo) / self.fanout
                edges = [n.lo + int(step * i) for i in range(self.fanout)] + [n.hi]
                cuts += [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
            out.append([Node(layer, i, a, b) for i, (a, b) in enumerate(cuts)])
            if all(b - a == 1 for a, b in cuts):
                break
        return out

    @property
    def height(self) -> int:
        return len(self.layers)

    def places(self, layer: int) -> list[int]:
        """The node of each code at a layer."""
        out = [0] * self.size
        for n in self.layers[layer]:
            out[n.lo : n.hi] = [n.idx] * (n.hi - n.lo)
        return out

    def cover(self, lo: int, hi: int, first: int = 0) -> list[Node]:
        """The fewest nodes that make up [lo, hi), from layer `first` down."""
        lo, hi = max(lo, 0), min(hi, self.size)
        out: list[Node] = []
        open_ = [(lo, hi)] if lo < hi else []
        for layer in self.layers[first:]:
            rest = []
            for a, b in open_:
                at = a
                for n in layer:
                    if n.lo >= a and n.hi <= b:
                        if n.lo > at:
                            rest.append((at, n.lo))
                        out.append(n)
                        at = n.hi
                if at < b:
                    rest.append((at, b))
            open_ = rest
        return out


def node_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    rows = [(t.attr, n.layer, n.idx, n.lo, n.hi) for t in trees for layer in t.layers for n in layer]
    return spark.createDataFrame(rows, "attr string, layer int, idx int, lo long, hi long")
