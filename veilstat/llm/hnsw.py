"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, as flat neighbour arrays.

Shards hold about SHARD vectors, dealt round robin whatever their ids or values. A shard's distinct vectors get levels
by a hash; each is linked, level by level, to the nearest of those before it in hash order, picked for spread, with
links back. Vectors get one more coordinate that brings all to one norm, so the largest inner product is the nearest
point. A query descends each shard's graph; the shards' best are merged by exact double-precision products.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .vectors import clean

#: Vectors of a shard, links of a node (twice that on the lowest level), nodes tried when linking and when searching.
SHARD, LINKS, BUILD, EF, BLOCK = 8192, 16, 64, 128, 4096
_INDEX = "dim int, n int, starts binary, ids binary, vectors binary, levels binary, links binary"


def _spread(order: np.ndarray, far: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of distance, those nearer to the node than to any picked before; then the nearest rest."""
    picked: list[int] = []
    rest: list[int] = []
    between = order @ order.T
    for i in range(len(far)):
        if len(picked) >= most:
            break
        if picked and (2 - 2 * between[i, picked] < far[i]).any():
            rest.append(i)
        else:
            picked.append(i)
    return picked + rest[: most - len(picked)]


class Graph:
    """A navigable small-world hierarchy over unit vectors: links[level, node, :] holds node numbers, -1 for none."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: np.ndarray):
        self.x, self.levels, self.links = x, levels, links
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7) -> Graph:
        n, rng = len(x), np.random.default_rng(seed)
        order = rng.permutation(n)
        x32 = x.astype(np.float32)
        levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int8), 6)
        top = int(levels.max(initial=0))
        links = np.full((top + 1, n, 2 * LINKS), -1, np.int32)
        for level in range(top + 1):
            members = order[levels[order] >= level]
            most = LINKS if level else 2 * LINKS
            near: list[list[int]] = [[] for _ in range(len(members))]
            m = x32[members]
            for lo in range(0, len(members), 256):
                hi = min(lo + 256, len(members))
                s = m[lo:hi] @ m[:hi].T
                for i in range(lo, hi):
                    if not i:
                        continue
                    row = s[i - lo, :i]
                    c = np.argpartition(-row, BUILD)[:BUILD] if i > BUILD else np.arange(i)
                    c = c[np.argsort(-row[c], kind="stable")]
                    got = c[_spread(m[c], 2 - 2 * row[c], LINKS)]
                    near[i] = got.tolist()
                    for j in near[i]:
                        back = near[j]
                        back.append(i)
                        if len(back) > 2 * most:
                            near[j] = cls._trim(m, j, back, most)
            for i, own in enumerate(near):
                if len(own) > most:
                    own = cls._trim(m, i, own, most)
                links[level, members[i], : len(own)] = members[own]
        return cls(x32, levels, links)

    @staticmethod
    def _trim(m: np.ndarray, i: int, own: list[int], most: int) -> list[int]:
        c = np.array(own)
        far = 2 - 2 * (m[c] @ m[i])
        o = np.argsort(far, kind="stable")
        c = c[o]
        return c[_spread(m[c], far[o], most)].tolist()

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        """About the ef nearest nodes of a point."""
        x, links, at = self.x, self.links, self.entry
        best = float(x[at] @ q)
        for level in range(int(self.levels[at]), 0, -1):
            while True:
                near = links[level, at]
                near = near[near >= 0]
                if not len(near):
                    break
                s = x[near] @ q
                j = int(s.argmax())
                if s[j] <= best:
                    break
                at, best = int(near[j]), float(s[j])
        seen = bytearray(len(x))
        seen[at] = 1
        todo, found = [(-best, at)], [(best, at)]
        base = links[0]
        while todo:
            s, at = heapq.heappop(todo)
            if -s < found[0][0] and len(found) >= ef:
                break
            near = [j for j in base[at].tolist() if j >= 0 and not seen[j]]
            if not near:
                continue
            for j in near:
                seen[j] = 1
            for s, j in zip((x[near] @ q).tolist(), near):
                if len(found) < ef:
                    heapq.heappush(found, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, j))
                    heapq.heappush(todo, (-s, j))
        return [j for _, j in found]


def _index(tops: dict[int, float]) -> Callable:
    def rows(d: int, ids: np.ndarray, v: np.ndarray):
        for lo in range(0, len(ids), SHARD + SHARD // 2):
            own, part = ids[lo : lo + SHARD + SHARD // 2], v[lo : lo + SHARD + SHARD // 2]
            u, group = np.unique(part, axis=0, return_inverse=True)  # equal vectors share a node
            o = np.lexsort((own, group.reshape(-1)))
            starts = np.searchsorted(group.reshape(-1)[o], np.arange(len(u) + 1))
            top = np.sqrt(tops[d])
            x = u / top
            x = np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]])
            g = Graph.build(x)
            row = [d, len(u), starts.astype(np.int64).tobytes(), own[o].tobytes(), u.tobytes(), g.levels.tobytes(), g.links.tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["dim", "n", "starts", "ids", "vectors", "levels", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            lens = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            for d in np.unique(lens):
                here = np.flatnonzero(lens == d)
                v = lists.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))
                held.setdefault(int(d), []).append((ids[here], v))
                if sum(len(x[0]) for x in held[int(d)]) >= SHARD + SHARD // 2:
                    yield from rows(int(d), *(np.concatenate(x) for x in zip(*held.pop(int(d)))))
        for d, parts in held.items():
            yield from rows(d, *(np.concatenate(x) for x in zip(*parts)))

    return run


def build_index(vectors: DataFrame) -> DataFrame:
    """The written graphs over vectors(vec_id, v array<double>), one row each."""
    common.prepare(vectors.sparkSession)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    got = vectors.groupBy(F.size("v")).agg(F.max(norm), F.count("*")).collect()  # one row per vector length
    tops, n = {r[0]: float(r[1]) for r in got}, sum(r[2] for r in got)
    return common.materialize(vectors.repartition(max(1, -(-n // SHARD))).mapInArrow(_index(tops), _INDEX), "hnsw")


def _search(q_ids: dict, q_vecs: dict, k: int, ef: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                d, n, starts, ids, vecs, levels, links = (b.column(i)[at].as_py() for i in range(7))
                if d not in q_vecs:
                    continue
                starts, ids = np.frombuffer(starts, np.int64), np.frombuffer(ids, np.int64)
                v, levels = np.frombuffer(vecs, np.float64).reshape(n, d), np.frombuffer(levels, np.int8)
                links = np.frombuffer(links, np.int32).reshape(-1, n, 2 * LINKS)
                # queries keep their direction only, so a zero last coordinate is enough
                lifted = np.hstack([v, np.zeros((n, 1))])
                top = np.sqrt((v * v).sum(1).max())
                lifted[:, -1] = np.sqrt(np.maximum(top * top - (v * v).sum(1), 0))
                g = Graph((lifted / top).astype(np.float32), levels, links)
                out_q, out_i, out_s = [], [], []
                for qid, q in zip(q_ids[d], q_vecs[d]):
                    unit = np.append(q / np.sqrt(q @ q), 0).astype(np.float32)
                    nodes = np.array(g.search(unit, max(ef, k + 1)))
                    s = v[nodes] @ q
                    o = np.lexsort((ids[starts[nodes]], -s))[: k + 1]
                    for j in o:
                        some = ids[starts[nodes[j]] : starts[nodes[j] + 1]]
                        some = some[: k + 1 + int((some == qid).sum())]
                        some = some[some != qid]
                        out_q.append(np.full(len(some), qid))
                        out_i.append(some)
                        out_s.append(np.full(len(some), s[j]))
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_i, out_s)], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found over all shards, ties to the smaller id.

    queries: vec_id, v. Rows with the query's own id are no candidates; a query id that occurs more than once is asked
    once, with its smallest vector; equal rows are found one by one. Queries go to all shards in blocks of BLOCK.
    """
    spark = common.prepare(index.sparkSession)
    asked = common.materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    blocks, out = max(1, -(-n // BLOCK)), []
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()  # about BLOCK rows
        q_ids, q_vecs = {}, {}
        for d in {len(r["v"]) for r in rows}:
            own = [r for r in rows if len(r["v"]) == d]
            q_ids[d], q_vecs[d] = np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64)
        got = index.mapInArrow(_search(q_ids, q_vecs, k, ef), "query_id long, vec_id long, score double")
        got = got.withColumn("rank", F.row_number().over(by).cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
        out.append(common.materialize(got, "near") if blocks > 4 else got)
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + ([out[-1]] if len(out) % 2 else [])
    return out[0]


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each row whose id is divisible by 20; vectors null, zero or not finite take no part."""
    rows = common.materialize(clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", zero=False), "vectors")
    return search(build_index(rows), rows.where("vec_id % 20 = 0"), 20)
