"""Substring dedup: words covered by a window that starts anywhere else too, counted exactly by super-k-mers.

The windows of a text whose rarest-looking run of MER words (its minimiser, by hash) is the same stand next to each
other; each such stretch travels once, as one packed string, to the bucket of its minimiser. Equal windows have equal
minimisers, so a bucket can count its windows by sorting. Stretches that already repeat within a task are known to be
repeated: their places need no count, and only one copy travels.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a minimiser; words that a task packs at once; bytes of input per bucket.
MER, PACK, BUCKET_BYTES = 4, 1_000_000, 3_000_000
_HEAD = struct.Struct("<6I")
_OCC, _KNOWN = (np.int32, np.int64, np.int64, np.int32), (np.int64, np.int64, np.int32, np.int32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def _stretches(h: np.ndarray, doc: np.ndarray, k: int):
    """First window, number of windows and minimiser of each stretch of windows within one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = min(MER, k)
    mer = np.zeros(len(h) - m + 1, np.uint64)
    for j in range(m):
        mer = _mix(mer + h[j : len(h) - m + 1 + j])
    low = _least(mer, k - m + 1)
    ok = doc[:n] == doc[k - 1 :]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1])
    at = np.flatnonzero(new & ok)
    # a window past the end of its document ends a stretch
    stop = np.flatnonzero(np.concatenate([new | ~ok, [True]]))
    return at, stop[np.searchsorted(stop, at, "right")] - at, low[at]


def _pack(contents: list[bytes], weights, occ, known) -> bytes:
    """occ: (content, k1, k2, start) of places to be judged; known: (k1, k2, start, words) of places already judged."""
    import zstandard

    body = b"\n".join(contents)
    arrays = [np.asarray(weights, np.int32), *(np.asarray(x, t) for x, t in zip(occ, _OCC)), *(np.asarray(x, t) for x, t in zip(known, _KNOWN))]
    raw = _HEAD.pack(len(contents), len(body), len(occ[0]), len(known[0]), 0, 0) + body + b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=6).compress(raw)


def _unpack(blob: bytes):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, size, n_occ, n_known, _, _ = _HEAD.unpack_from(raw)
    at = _HEAD.size + size
    contents = raw[_HEAD.size : at].split(b"\n") if n else []

    def take(count, kind):
        nonlocal at
        a = np.frombuffer(raw, kind, count, at)
        at += a.nbytes
        return a

    return contents, take(n, np.int32), [take(n_occ, t) for t in _OCC], [take(n_known, t) for t in _KNOWN]


def _deal(k: int, buckets: int) -> Callable:
    def flush(words, keys, counts):
        doc = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        at, n, low = _stretches(_hashes(words), doc, k)
        if not len(at):
            return
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        joined = b" ".join(words)
        a, z = (ends[at] - np.fromiter((len(words[i]) for i in at), np.int64, len(at)) - 1).tolist(), (ends[at + n + k - 2] - 1).tolist()
        text = [joined[i:j] for i, j in zip(a, z)]
        number: dict[bytes, int] = {}
        own = np.fromiter((number.setdefault(x, len(number)) for x in text), np.int64, len(text))
        times = np.bincount(own, minlength=len(number))
        distinct = list(number)
        lead = np.zeros(len(number), np.int64)
        lead[own[::-1]] = np.arange(len(own))[::-1]
        bucket_of = (low[lead] % np.uint64(buckets)).astype(np.int64)
        d = doc[at]
        k1, k2, start = keys[0][d], keys[1][d], at - first[d]
        many = times[own] > 1
        order = np.argsort(bucket_of, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        cuts = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
        occ = np.argsort(bucket_of[own], kind="stable")
        occ_cuts = np.searchsorted(bucket_of[own][occ], np.arange(buckets + 1))
        for b in np.unique(bucket_of):
            here, places = order[cuts[b] : cuts[b + 1]], occ[occ_cuts[b] : occ_cuts[b + 1]]
            one, more = places[~many[places]], places[many[places]]
            yield int(b), _pack([distinct[i] for i in here], np.minimum(times[here], 2), (rank[own[one]] - cuts[b], k1[one], k2[one], start[one]), (k1[more], k2[more], start[more], n[more] + k - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, k1, k2, counts = [], [], [], []

        def out():
            rows = list(flush(words, (np.array(k1, np.int64), np.array(k2, np.int64)), np.array(counts, np.int64)))
            for x in (words, k1, k2, counts):
                x.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for a, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(w) < k:
                    continue
                words += w
                k1.append(a)
                k2.append(c)
                counts.append(len(w))
                if len(words) >= PACK:
                    yield from out()
        yield from out()

    return run


def _repeated(ids: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Whether each window ids[at : at + k] occurs with a total weight of 2 or more. Exact: equal hashes are compared."""
    power = np.ones(len(ids) + 1, np.uint64)
    power[1:] = np.uint64(0xD1342543DE82EF95)
    power = np.multiply.accumulate(power)
    back = np.ones(len(ids) + 1, np.uint64)
    back[1:] = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    back = np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(ids.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    h = (total[at + k] - total[at]) * back[at]
    order = np.argsort(h, kind="stable")
    p, q = at[order[:-1]], at[order[1:]]
    same = h[order[1:]] == h[order[:-1]]
    s = np.flatnonzero(same)
    equal = np.ones(len(s), bool)
    for j in range(k):
        equal &= ids[p[s] + j] == ids[q[s] + j]
    group = np.concatenate([[0], np.cumsum(~same)])
    sums = np.bincount(group, weights=weight[order])
    out = np.zeros(len(at), bool)
    out[order] = sums[group] >= 2
    for g in np.unique(group[s[~equal] + 1]):  # unequal windows with one hash
        tally: dict[bytes, int] = {}
        members = order[group == g]
        for i in members:
            key = ids[at[i] : at[i] + k].tobytes()
            tally[key] = tally.get(key, 0) + int(weight[i])
        for i in members:
            out[i] = tally[ids[at[i] : at[i] + k].tobytes()] >= 2
    return out


def _judge(k: int) -> Callable:
    names = ["k1", "k2", "start", "words"]

    def judge(blobs):
        number: dict[bytes, int] = {}
        weights: list[int] = []
        occ: list = [[], [], [], []]
        for blob in blobs:
            contents, w, o, known = _unpack(blob)
            local = np.zeros(len(contents), np.int64)
            for i, c in enumerate(contents):
                j = number.setdefault(c, len(number))
                if j == len(weights):
                    weights.append(0)
                weights[j] += int(w[i])
                local[i] = j
            occ[0].append(local[o[0]])
            for i in (1, 2, 3):
                occ[i].append(o[i])
            if len(known[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in known], names=names)
        if not number:
            return
        parts = pc.split_pattern(pa.array(list(number), pa.large_binary()), b" ")
        del number
        lens = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        flat = parts.values.dictionary_encode().indices.to_numpy()
        del parts
        first, n = np.cumsum(lens) - lens, lens - k + 1
        of = np.repeat(np.arange(len(lens)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        twice = _repeated(flat, first[of] + step, np.array(weights, np.float64)[of], k)
        del flat
        # runs of repeated windows, for each content
        i = np.flatnonzero(twice)
        if not len(i):
            return
        begin = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (of[i[1:]] != of[i[:-1]])])
        r = np.flatnonzero(begin)
        run_of, run_at, run_n = of[i[r]], step[i[r]], np.diff(np.concatenate([r, [len(i)]]))
        lo, hi = np.searchsorted(run_of, np.arange(len(lens))), np.searchsorted(run_of, np.arange(len(lens)), "right")
        c, k1, k2, start = (np.concatenate(x) for x in occ)
        each = (hi - lo)[c]
        place = np.repeat(np.arange(len(c)), each)
        run = lo[c][place] + np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each)
        for a in range(0, len(place), 100_000):
            p, q = place[a : a + 100_000], run[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k1[p]), pa.array(k2[p]), pa.array(start[p].astype(np.int64) + run_at[q]), pa.array(run_n[q] + k - 1)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != at and held:
                    yield from judge(held)
                    held = []
                at = bucket
                held.append(blob.as_py())
        if held:
            yield from judge(held)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list = [[], [], [], []]
        for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            spans = b.column(2)[i].as_py()
            n = len(words)
            if spans:
                edge = np.zeros(n + 1, np.int32)
                s = np.array([x["start"] for x in spans])
                np.add.at(edge, s, 1)
                np.add.at(edge, s + np.array([x["words"] for x in spans]), -1)
                words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            for x, y in zip(out, (doc, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest())):
                x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a 128-bit key of id and text; equal rows share it, and share what is removed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit("k"), "doc_id").alias("k2"), "doc_id", "text")


def repeated_spans(docs: DataFrame, window: int, buckets: int | None = None) -> DataFrame:
    """k1, k2, start, words: stretches of words (may overlap) that are covered by windows occurring twice or more.

    A bucket is judged in one task, from distinct stretches and the places of those that a task saw once; its size
    follows the number of buckets, which grows with the input. A passage shared by any number of documents comes at
    most once from each task that packs, so a hot minimiser grows with tasks, not with copies.
    """
    spark = common.prepare(docs.sparkSession)
    if not buckets:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = max(64, size // BUCKET_BYTES)
    dealt = _keyed(docs).select("k1", "k2", "text").mapInArrow(_deal(window, buckets), "bucket int, blob binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 8))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(window), "k1 long, k2 long, start long, words long")


def dedup(docs: DataFrame, window: int = 50, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs(doc_id, text).

    Removed is each word covered by a window of that many words whose sequence also starts anywhere else, in the same
    row or another; all windows are judged on the input. Null texts have no words; texts shorter than a window lose
    none; repeated rows lose all that windows cover.
    """
    spans = repeated_spans(docs, window, buckets).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "words")).alias("spans"))
    rows = _keyed(docs).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words over all documents."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35)


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
d AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM x JOIN d USING (g)),
k AS (SELECT doc_id, count(*) AS kept, string_agg(t, ' ' ORDER BY j) AS text FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS j FROM w) ANTI JOIN c USING (doc_id, j) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
