"""Exact top-k inner products through a pivot-distance index.

Vectors get one more coordinate that brings all to one norm, so the largest inner product is the nearest point. Each
vector is keyed by its nearest pivot and its distance from it; the table is range-sorted by that key and packed into
annuli. A query skips an annulus as soon as the triangle inequality puts all of it beyond the k-th best so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Pivots, the bounded sample they are fitted on, vectors of an annulus, queries of a block.
PIVOTS, SAMPLE, RING, BLOCK = 64, 4096, 256, 4096
_RINGS = "dim int, pivot int, low double, high double, ids binary, data binary"


def clean(df: DataFrame, id_col: str, vec_col: str, zero: bool = True) -> DataFrame:
    """vec_id, v (array of double) of rows whose vector is not null or empty and has finite components only."""
    v = F.col("v")
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    out = out.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return out if zero else out.where(F.exists(v, lambda x: x != 0))


def matrix(column, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype)


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means centres, started from the farthest points in turn."""
    if len(sample) <= n:
        return np.unique(sample, axis=0)
    picks = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(picks) < n and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picks[-1]]) ** 2).sum(1))
    centres = sample[picks].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        for i in range(len(centres)):
            if (own == i).any():
                centres[i] = sample[own == i].mean(0)
    return centres


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    ids = b.column(0).to_numpy(zero_copy_only=False)
    lens = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
    for d in np.unique(lens):
        here = np.flatnonzero(lens == d)
        yield int(d), ids[here], matrix(b.column(1).take(pa.array(here)), np.int64)


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    f = v.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(top - (f * f).sum(1), 0))[:, None]])


def _assign(pivots: dict[int, np.ndarray], tops: dict[int, float]) -> Callable:
    def run(batches):
        for b in batches:
            for d, ids, v in _by_dim(b):
                x, p = _lift(v, tops[d]), pivots[d]
                far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))
                own = far.argmin(1)
                exact = np.sqrt(((x - p[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), d, np.int32)), pa.array(own.astype(np.int32)), pa.array(exact), pa.array(ids), pa.array([r.tobytes() for r in v], pa.binary())], names=["dim", "pivot", "dist", "vec_id", "data"])

    return run


def _pack(batches):
    held: list = []

    def ring():
        d, p = held[0][0], held[0][1]
        row = [[d], [p], [held[0][2]], [held[-1][2]], [np.array([x[3] for x in held], np.int64).tobytes()], [b"".join(x[4] for x in held)]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()])], names=["dim", "pivot", "low", "high", "ids", "data"])

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5))):
            if held and (held[0][:2] != row[:2] or len(held) >= RING):
                yield ring()
            held.append(row)
    if held:
        yield ring()


def build_index(ints: DataFrame, tag: str = "rings", n_pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, dict, dict]:
    """The written table of annuli over ints(vec_id, v array<long>), with pivots and the largest squared norm by length.

    Pivots come from at most `sample` vectors (smallest hashes), whatever the size of the table. The range sort is by
    pivot, distance and id, so a pivot with most of the vectors, or one vector that fills the table, still spreads.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    tops = {r[0]: float(r[1]) for r in ints.groupBy(F.size("v")).agg(F.max(norm)).collect()}
    pivots = {}
    for d in tops:
        some = ints.where(F.size("v") == d).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").collect()
        pivots[d] = fit_pivots(_lift(np.array([r[0] for r in some], np.int64), tops[d]), n_pivots)
    keyed = ints.mapInArrow(_assign(pivots, tops), "dim int, pivot int, dist double, vec_id long, data binary")
    order = ["dim", "pivot", "dist", "vec_id"]
    rings = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, _RINGS)
    return common.materialize(rings, tag), pivots, tops


def _merge(best_s, best_i, rows, scores, ids, least, k):
    """Best k of the rows' lists and new scores, by score downward, then id."""
    for r, s in zip(rows, scores):
        keep = np.flatnonzero(s >= least[r])
        alls, alli = np.concatenate([best_s[r], s[keep]]), np.concatenate([best_i[r], ids[keep]])
        order = np.lexsort((alli, -alls))[:k]
        best_s[r], best_i[r] = alls[order], alli[order]


_LOW = np.iinfo(np.int64).min + 1


def _search(q_ids: dict, q_vecs: dict, floors: dict, pivots: dict, tops: dict, k: int, home_only: bool) -> Callable:
    def run(batches):
        state = {}
        for d, q in q_vecs.items():
            x = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
            p = pivots[d]
            far = np.sqrt(((x[:, None, :] - p[None]) ** 2).sum(2)) if len(x) * p.size < 2e7 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))
            best_s, best_i = np.full((len(q), k), _LOW), np.full((len(q), k), np.iinfo(np.int64).max)
            floor = floors.get(d, np.full(len(q), _LOW + 1))  # a score that k others are known to reach
            big = float(np.abs(q).max(initial=0)) * np.sqrt(tops[d]) * d
            state[d] = (far, (x * x).sum(1), best_s, best_i, floor, big < 2**53, far.argmin(1))
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(6))))
            for d, p, low, high, ids, data in rows:
                if d not in state:
                    continue
                far, norms, best_s, best_i, floor, floats, home = state[d]
                least = np.maximum(best_s[:, -1], floor)
                gap = np.maximum(np.maximum(far[:, p] - high, low - far[:, p]), 0)
                bound = (norms + tops[d] - gap * gap) / 2
                slack = 1e-9 * (norms + tops[d] + far[:, p] ** 2) + 1
                open_ = bound + slack >= least
                if home_only:
                    open_ &= (home == p) & (gap <= np.maximum(high - low, 0) + 1e-9)
                act = np.flatnonzero(open_)
                if not len(act):
                    continue
                v, own = np.frombuffer(data, np.int64).reshape(-1, d), np.frombuffer(ids, np.int64)
                q = q_vecs[d][act]
                s = np.rint(q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if floats else q @ v.T
                s[q_ids[d][act][:, None] == own[None]] = _LOW
                better = np.flatnonzero(s.max(1) >= least[act])
                _merge(best_s, best_i, act[better], s[better], own, least, k)
        for d, (_, _, best_s, best_i, *_) in state.items():
            ok = best_i != np.iinfo(np.int64).max
            r = np.nonzero(ok)[0]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[d][r]), pa.array(best_i[ok]), pa.array(best_s[ok])], names=["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products over all rows with another id.

    vectors, queries: vec_id long, v array<long>, without nulls. Ties go to the smaller id. A vector of another
    length than the query's is no candidate; a query id that occurs more than once is asked once, with its smallest
    vector; equal rows are candidates one by one. Queries are asked in blocks of BLOCK, each sent to all annuli twice:
    first to those around its own place, whose k-th best score then bounds the full pass.
    """
    spark = common.prepare(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score long"
    ints = common.materialize(vectors, "ints")
    asked = common.materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    if not n:
        return spark.createDataFrame([], schema)
    index, pivots, tops = build_index(ints, n_pivots=n_pivots)
    blocks, out = -(-n // BLOCK), []
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()  # about BLOCK rows
        q_ids, q_vecs = {}, {}
        for d in {len(r["v"]) for r in rows} & set(pivots):
            own = [r for r in rows if len(r["v"]) == d]
            q_ids[d], q_vecs[d] = np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64)
        shape = "query_id long, vec_id long, score long"
        near = index.mapInArrow(_search(q_ids, q_vecs, {}, pivots, tops, k, True), shape)
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = dict(near.withColumn("rank", F.row_number().over(by)).where(f"rank = {k}").select("query_id", "score").collect())
        floors = {d: np.array([kth.get(int(x), _LOW + 1) for x in ids], np.int64) for d, ids in q_ids.items()}
        got = index.mapInArrow(_search(q_ids, q_vecs, floors, pivots, tops, k, False), shape)
        got = got.withColumn("rank", F.row_number().over(by).cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
        out.append(common.materialize(got, "top") if blocks > 4 else got)
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + ([out[-1]] if len(out) % 2 else [])
    return out[0]


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of each row whose id is divisible by 50."""
    rows = clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    ints = rows.select("vec_id", F.transform("v", lambda x: F.floor(256 * x).cast("long")).alias("v"))
    return exact_topk(ints, ints.where("vec_id % 50 = 0"), 5)


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= 5
"""
