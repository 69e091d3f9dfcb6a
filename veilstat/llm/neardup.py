"""MinHash near-dedup with sequential Bayesian verification and exact confirmation on full shingle sets.

Documents with equal shingle sets form one class. Signatures of classes are cut into bands; classes that share a band
are candidates. A candidate pair is compared by batches of its signatures and dropped as soon as the posterior
probability that its similarity reaches the threshold falls below the chosen miss probability; survivors are compared
on their full sets. Pairs are tried in an order that lets components grow first, so a group of any size costs about one
confirmed pair per member, not one per pair; what is left open between components is then searched whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a band; chance that a pair at the threshold shares no band; posterior below which a pair is dropped; signatures per batch.
ROWS, MISS, POSTERIOR, BATCH = 5, 1e-6, 1e-7, 16
#: Distinct words a Python worker remembers.
CACHE_ENTRIES = 600_000
_P = np.uint64(0x9E3779B97F4A7C15)
_state: dict = {"words": {}}


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def signatures_for(threshold: float) -> int:
    return -(-max(128, ROWS * bands_for(threshold)) // BATCH) * BATCH


def least_matches(n: int, threshold: float, posterior: float = POSTERIOR) -> int:
    """Fewest equal signatures of n with which P(similarity >= threshold) is at least the posterior, uniform prior."""
    total = 0.0
    for m in range(n + 1):  # P = P(Binomial(n + 1, threshold) <= m)
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= posterior:
            return m
    return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle, a text without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _state["words"]
    if len(known) > CACHE_ENTRIES:
        known.clear()
    for w in [w for w in words if w not in known]:
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(len(h) if len(h) < k else k))
    for j in range(min(k, len(h))):
        out = _mix(out + h[j : j + n])
    return np.unique(out)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    for lo in range(0, len(x), 1024):
        np.minimum(out, (x[lo : lo + 1024, None] * a + b).min(0) if len(x) < 16 else (a[:, None] * x[None, lo : lo + 1024] + b[:, None]).min(1), out=out)
    return out


def _sign(k: int, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b_ = _factors(n)
        for b in batches:
            size, digest, sig = [], [], []
            for x in b.column(1):
                s = shingles(x.as_py(), k)
                size.append(len(s))
                digest.append(hashlib.md5(s.tobytes()).digest())
                sig.append(signature(s, a, b_).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])
        _state["words"].clear()  # the worker lives on under other operators

    return run


def _band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    s, out = sig.astype(np.uint64), np.zeros((len(sig), bands), np.uint64)
    for i in range(bands):
        h = np.full(len(sig), np.uint64(i + 1))
        for j in range(ROWS):
            h = _mix(h + s[:, i * ROWS + j])
        out[:, i] = h
    return out


def _bands(bands: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1), bands)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), bands)
            for lo in range(0, len(ids), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1)[lo : lo + 50_000].view(np.int64)), pa.array(ids[lo : lo + 50_000])], names=["band", "node"])

    return run


def _prune(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
            live, hits = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for lo in range(0, x.shape[1], BATCH):
                hits = hits + (x[live, lo : lo + BATCH] == y[live, lo : lo + BATCH]).sum(1)
                ok = hits >= least_matches(lo + BATCH, threshold)
                live, hits = live[ok], hits[ok]
            yield b.select(["a", "b"]).take(pa.array(live))

    return run


def _confirm(k: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3)):
                if last[0] != x:
                    last = (x, shingles(x, k))
                s, t = last[1], shingles(y.as_py(), k)
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(bool(both and 100 * both >= percent * (len(s) + len(t) - both)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])
        _state["words"].clear()

    return run


def _open_links(k: int, percent: int, bands: int) -> Callable:
    """Within each band (rows sorted by it), links that join components, after trying all pairs between them.

    A pair is tried in the first band that it shares only. Pairs are never rows: a class is compared with all others of
    its band at once, and what comes out is at most one link per class and component that it joins.
    """
    threshold = percent / 100

    def search(key, node, comp, sig, texts):
        n, cuts = len(node), {lo: least_matches(lo + BATCH, threshold) for lo in range(0, sig.shape[1], BATCH)}
        parts = sig[:, : bands * ROWS].reshape(n, bands, ROWS)
        own = int(np.flatnonzero(_band_keys(sig[:1], bands)[0].view(np.int64) == key)[0])
        sets = [shingles(t, k) for t in texts]
        size = np.array([len(s) for s in sets])
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(size) - size
        group = np.unique(comp, return_inverse=True)[1]
        for i in range(n - 1):
            c = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
            hits = np.zeros(len(c), np.int64)
            for lo, least in cuts.items():
                hits = hits + (sig[c, lo : lo + BATCH] == sig[i, lo : lo + BATCH]).sum(1)
                c, hits = c[hits >= least], hits[hits >= least]
            c = c[(parts[c, :own] == parts[i, :own]).all(2).sum(1) == 0] if own else c
            if not len(c):
                continue
            if len(c) < 16:
                both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in c])
            else:
                mark = np.zeros(len(vocabulary), np.int32)
                mark[flat[first[i] : first[i] + size[i]]] = 1
                both = np.add.reduceat(mark[flat], first)[c]
            for j in c[100 * both >= percent * (size[i] + size[c] - both)]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    yield int(min(node[i], node[j])), int(max(node[i], node[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out():
            node, comp = np.array([r[1] for r in held]), np.array([r[2] for r in held])
            sig = np.frombuffer(b"".join(r[3] for r in held), np.uint32).reshape(len(held), -1)
            pairs = list(search(at, node, comp, sig, [r[4] for r in held]))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if row[0] != at and held:
                    yield from out()
                    held = []
                at = row[0]
                held.append(row)
        if held:
            yield from out()

    return run


def classes(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles (letters A-Z
    lower-cased); component_id is the smallest id reachable, the row's own included. Rows without words have an empty
    set and no links. Rows with one id are one document. Rows with a null id join the component of equal sets, if any,
    else theirs is null; they make no links. Bands are found at a chance of MISS to overlook a pair at the threshold.
    """
    spark = common.prepare(docs.sparkSession)
    threshold = percent / 100
    n = signatures_for(threshold)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = common.materialize(rows.mapInArrow(_sign(k, n), "doc_id long, n_shingles long, digest binary, sig binary"), "signed")
    # one node for each set: the smallest id that has it; a group of copies is one map-side combined minimum
    lead = common.materialize(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    sigs = signed.join(lead.where("node is not null"), "digest").where("doc_id = node").select("node", "sig").dropDuplicates(["node", "sig"])
    sigs = common.materialize(sigs, "sigs")
    bands = sigs.mapInArrow(_bands(bands_for(threshold)), "band long, node long").distinct()
    bands = common.materialize(bands, "bands")
    heads = bands.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1")
    shared = common.materialize(bands.join(heads, "band"), "shared")
    texts = rows.where("doc_id is not null")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sigs.select(F.col("node").alias("a"), F.col("sig").alias("x"))
        y = sigs.select(F.col("node").alias("b"), F.col("sig").alias("y"))
        near = common.materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_prune(threshold), "a long, b long").distinct(), "near")
        x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
        y = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
        both = near.join(y, "b").join(x, "a").select("a", "b", "x", "y")
        return common.materialize(both.mapInArrow(_confirm(k, percent), "a long, b long, linked boolean"), "confirmed")

    def grown(links: list[DataFrame]) -> DataFrame:
        return common.components(reduce(DataFrame.unionByName, [x.where("linked").select("a", "b") for x in links]))

    def placed(df: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    # first each class with the smallest head over its bands, then with the other heads, then all that stays open
    found = [confirmed(shared.where("node > head").groupBy("node").agg(F.min("head").alias("a")).select("a", F.col("node").alias("b")))]
    comps = grown(found)
    rest = shared.where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    rest = placed(placed(rest, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b")
    rest = common.materialize(rest.join(found[0].select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if rest.take(1):
        found.append(confirmed(rest))
        comps = grown(found)
    inside = placed(shared.where("size > 2"), comps, "node", "comp")
    mixed = inside.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    open_ = common.materialize(inside.join(mixed, "band").select("band", "node", "comp"), "open")
    held = open_.select("node").distinct().join(sigs, "node").join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    ready = open_.join(held, "node").select("band", "node", "comp", "sig", "text").repartition(F.col("band")).sortWithinPartitions("band")
    more = common.materialize(ready.mapInArrow(_open_links(k, percent, bands_for(threshold)), "a long, b long").distinct(), "open")
    if more.take(1):
        comps = grown([*found, more.withColumn("linked", F.lit(True))])
    final = placed(lead, comps, "node", "component_id").select("digest", "component_id")
    return signed.select("doc_id", "n_shingles", "digest").join(final, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles at a similarity of 0.85 over all documents."""
    got = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with the document of smallest id of each component, once; rows without words or id stay as they are."""
    got = classes(docs, k, percent).where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(got, "doc_id", "left_anti").select(*docs.columns)
    return left


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) m ON m.node = d.doc_id
"""
