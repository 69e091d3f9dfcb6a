"""The query language: select sum|avg|count(column) from t where predicate [and predicate]*, bound to codes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SELECT = re.compile(r"\s*select\s+(\w+)\s*\(\s*([\w.*-]+)\s*\)\s+from\s+[\w.-]+(?:\s+where\s+(.*?))?\s*;?\s*", re.I | re.S)
_RANGE = re.compile(r"(-?\d+)\s*<=\s*([\w.-]+)\s*<=\s*(-?\d+)")
_POINT = re.compile(r"([\w.-]+)\s*=\s*'?([^'=<>]+?)'?")
FUNCTIONS = ("sum", "avg", "count")


@dataclass(frozen=True)
class Ordinal:
    """A number column in equal buckets: code = floor((v - low) / step)."""

    low: float
    high: float
    step: float = 1.0

    @property
    def size(self) -> int:
        return int((self.high - self.low) / self.step) + 1

    def code(self, v: float) -> int:
        return int((v - self.low) // self.step)


@dataclass(frozen=True)
class Category:
    """A column of labels; codes are places in their sorted order."""

    labels: tuple[str, ...]

    @property
    def size(self) -> int:
        return len(self.labels)

    def code(self, v: str) -> int:
        return sorted(self.labels).index(v.strip())


@dataclass(frozen=True)
class Query:
    """func over a public measure, where each predicate's column is in [low, high) of its codes."""

    func: str
    measure: str
    box: dict[str, tuple[int, int]] = field(default_factory=dict)


def parse(text: str) -> tuple[str, str, list[tuple[str, str, str]]]:
    """func, column and (column, low, high) per predicate; a point has low == high. Only AND is in the language."""
    m = _SELECT.fullmatch(text)
    if not m or m[1].lower() not in FUNCTIONS:
        raise ValueError(f"not a query: {text!r}")
    out = []
    for p in re.split(r"\s+and\s+", m[3].strip(), flags=re.I) if m[3] else []:
        if r := _RANGE.fullmatch(p.strip()):
            out.append((r[2], r[1], r[3]))
        elif e := _POINT.fullmatch(p.strip()):
            out.append((e[1], e[2].strip(), e[2].strip()))
        else:
            raise ValueError(f"not a predicate: {p!r}")
    return m[1].lower(), m[2], out


def bind(text: str, schema: dict[str, Ordinal | Category], as_index: bool = False) -> Query:
    """A query over codes. Bounds are inclusive values; as_index reads them as bucket numbers, the upper one exclusive."""
    func, measure, predicates = parse(text)
    box = {}
    for name, lo, hi in predicates:
        spec = schema[name]
        if isinstance(spec, Category) or lo == hi and not as_index:
            c = spec.code(lo if isinstance(spec, Category) else float(lo))
            box[name] = (c, c + 1)
        elif as_index:
            box[name] = (int(lo), int(hi) + (lo == hi))
        else:
            box[name] = (max(spec.code(float(lo)), 0), min(spec.code(float(hi)) + 1, spec.size))
    return Query(func, measure, box)


def read_queries(path: str) -> list[str]:
    """The queries of a text file, one per line."""
    with open(path) as f:
        return [x.strip() for x in f if x.strip()]


def random_box(sizes: dict[str, int], volume: float, seed: str, fixed: str | None = None) -> dict[str, tuple[int, int]]:
    """A box over ordinal attributes that covers about `volume` of their joint domain, at a place drawn from the seed.

    Each side is the same root of the volume; with `fixed`, that attribute alone is cut to the whole volume.
    """
    import hashlib

    out = {}
    names = [fixed] if fixed else list(sizes)
    share = volume if fixed else volume ** (1 / len(sizes))
    for name in names:
        length = max(1, int(sizes[name] * share))
        at = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16) % (sizes[name] - length + 1)
        out[name] = (at, at + length)
    return out
