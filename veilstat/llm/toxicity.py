"""Toxicity scores of texts restored by a noisy-channel decoder.

Tokens that look disguised (digits and signs for letters, letters spaced out, letters repeated) become a lattice of
letters, and the Viterbi path under a character trigram model with channel costs is the restored word. The trigrams are
counted over all documents. The score of a restored text is logistic in its most telling words; how telling a word is
comes from labelled documents, backed off from the word to its beginnings, so unseen endings of known stems count too.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents the classifier is fitted on at most (those with the smallest hashes of their ids).
FIT_ROWS = 20_000
#: Distinct tokens a Python worker remembers.
CACHE_ENTRIES = 400_000
#: Weight of the shorter stem's share of toxic texts against the longer one's; lengths of stems.
SHRINK, STEMS = 4.0, (3, 4, 5, 6)
#: Letters of the character model; all else is a boundary, symbol 0.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: Which letters a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SWAP, DROP_SIGN, DROP_DIGIT, DROP_EDGE, FOLD = 0.7, 5.0, 10.0, 0.2, 0.3
_SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}
_SIZE = len(LETTERS) + 1
_TABLE = np.zeros(0x250, np.int32)
for _c, _i in _SYMBOL.items():
    _TABLE[ord(_c)] = _i
#: Three or more single letters with one to four blanks or signs between; a sign for a letter may be the first or last.
_SPACED = re.compile(r"(?:(?<![^\W_])|(?<!\S)[@$!|+(€£][\s._*-]{1,2})[^\W_](?:[\W_]{1,4}[^\W_](?![^\W_])){2,}(?:[\s._*-]{1,2}[@$!|+(€£](?!\S))?")
_RUN = re.compile(r"(.)\1*", re.S)
_WORDS = re.compile(rf"[{LETTERS}]+|[^\W\d_{LETTERS}]+")
_PLAIN = re.compile(rf"[{LETTERS}]+")
_ODD = re.compile(r"(.)\1\1|[0-9@$!|+(€£]")
_DOUBLED = re.compile(r"([^\W\d_])\1+")
#: Where tokens are cut before decoding; what may stand for a letter; what is a number, and stays one.
_JOINS = re.compile(r"[-/.,;:'’_=]")
_SPELT = re.compile("[^\\W_]|[" + re.escape("".join(LEET)) + "]")
_NUMBER = re.compile(r"[$€£+(]*\d+[%+!€£$]*")
_APART = re.compile(r"[^\W_]{1,2}(?:[._*-][^\W_]{1,2}){3,}")
_EDGE = " \t.,;:?\"'`#%&*)[]{}<>/\\~^=_-…«»“”„’‘"


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(a < len(_TABLE), _TABLE[np.minimum(a, len(_TABLE) - 1)], 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for b in batches:
        held, n = [], 0
        for x in [*b.column(0).to_pylist(), None]:
            held.append(x or "")
            n += len(held[-1])
            if x is None or n > 1 << 20:
                s = _codes("  ".join(["", *held, ""]).lower())
                total += np.bincount((s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:], minlength=len(total))
                held, n = [], 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def trigrams(texts: DataFrame) -> np.ndarray:
    """Costs (negative logs) of the third symbol after two, from counts over all texts; a table of fixed size."""
    rows = texts.mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    c3 = np.zeros(_SIZE**3)
    c3[[r[0] for r in rows]] = [r[1] for r in rows]
    c3 = c3.reshape(_SIZE, _SIZE, _SIZE)
    c2 = c3.sum(0)
    p1 = (c2.sum(0) + 1) / (c2.sum() + _SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
    return (-np.log(p3)).astype(np.float32)


def _options(run: str, edge: bool, spaced: bool) -> list[tuple[str, float]]:
    c, n = run[0], len(run)
    if c in _SYMBOL:
        return [(run, 0.0)] if n < 3 else [(c, FOLD), (c * 2, 2 * FOLD)]
    if spaced and not c.isalnum() and c not in LEET:
        return [("", 0.0), (" ", 1.0)]
    out = [(x * m, SWAP * m) for x in LEET.get(c, "") for m in ((1,) if n == 1 else (1, 2))]
    drop = DROP_DIGIT if c.isdigit() else DROP_EDGE if edge or n > 1 else DROP_SIGN
    return [*out, ("", drop)]


def decode(token: str, cost: np.ndarray, spaced: bool = False) -> str:
    """The likeliest letters behind a lower-case token: Viterbi over pairs of symbols."""
    runs = [m[0] for m in _RUN.finditer(token)]
    states: dict = {(0, 0): (0.0, None)}  # the text is a chain of pieces, so that long tokens take linear time
    for i, run in enumerate(runs):
        nxt: dict = {}
        for out, extra in _options(run, i == len(runs) - 1, spaced):
            for (a, b), (c, text) in states.items():
                c += extra
                for x in out:
                    s = _SYMBOL.get(x, 0)
                    c += float(cost[a, b, s])
                    a, b = b, s
                if (a, b) not in nxt or nxt[a, b][0] > c:
                    nxt[a, b] = (c, (text, out) if out else text)
        states = nxt
    text, pieces = min(((c + float(cost[a, b, 0]), text) for (a, b), (c, text) in states.items()), key=lambda x: x[0])[1], []
    while text:
        text, out = text
        pieces.append(out)
    return "".join(reversed(pieces))


class Restorer:
    """Lower-cased words of texts, with disguised ones restored."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost

    def token(self, token: str) -> list[str]:
        """The words of a token, and those with doubled letters once more with single ones."""
        words = self._words(token.strip(_EDGE))
        return words + [x for w in words if (x := _DOUBLED.sub(r"\1", w)) != w]

    def _words(self, t: str) -> list[str]:
        if _PLAIN.fullmatch(t) and not _ODD.search(t):
            return [t]
        if _APART.fullmatch(t):
            return decode(t, self.cost, True).split()
        if not _ODD.search(t):
            return _WORDS.findall(t)
        out = []
        for x in _JOINS.split(t):
            if not _ODD.search(x):
                out += _WORDS.findall(x)
            elif _NUMBER.fullmatch(x) or not _SPELT.search(x):
                out += _WORDS.findall(x)
            else:
                out += _WORDS.findall(decode(x, self.cost))
        return out

    def spaced(self, text: str) -> list[str]:
        """Words out of letters that stand apart."""
        out = []
        for m in _SPACED.finditer(text):
            out += decode(m[0], self.cost, True).split()
        return out


@dataclass
class Model:
    cost: np.ndarray
    prior: float
    lexicon: dict[str, tuple[int, int]]
    weights: np.ndarray

    def evidence(self, word: str) -> float:
        """Log-odds of toxic texts with such a word against all."""
        p, get = self.prior, self.lexicon.get
        for n in STEMS:
            if len(word) > n and (got := get(word[:n])):
                p = (got[0] + SHRINK * p) / (got[1] + SHRINK)
        if got := get("=" + word):
            p = (got[0] + SHRINK * p) / (got[1] + SHRINK)
        return math.log(p / (1 - p)) - math.log(self.prior / (1 - self.prior))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.restore, self.known = model, Restorer(model.cost), {}

    def features(self, text: str) -> tuple[float, float, float, float]:
        text = text.lower()
        tokens = set(text.split())
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for t in [t for t in tokens if t not in known]:
            known[t] = max(map(self.model.evidence, self.restore.token(t)), default=0.0)
        top = heapq.nlargest(3, map(known.__getitem__, tokens))
        if apart := self.restore.spaced(text):
            top = heapq.nlargest(3, [*top, *map(self.model.evidence, apart)])
        top += [0.0] * (3 - len(top))
        return (*top, math.log1p(len(tokens)))

    def score(self, text: str) -> float:
        w = self.model.weights
        z = w[4] + sum(a * b for a, b in zip(w, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _words(cost: np.ndarray) -> Callable:
    def run(batches):
        r = Restorer(cost)
        for b in batches:
            out = []
            for x in b.column(0):
                t = (x.as_py() or "").lower()
                out.append(sorted({w for k in set(t.split()) for w in r.token(k)} | set(r.spaced(t))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), b.column(1), b.column(2), b.column(0)], names=["words", "toxic", "fold", "text"])

    return run


def _rows(model: Model) -> Callable:
    def run(batches):
        s = Scorer(model)
        for b in batches:
            x = np.array([s.features(t.as_py() or "") for t in b.column(0)], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), b.column(1)], names=["a", "b", "c", "d", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and intercept by Newton steps, ridge on standardised weights."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w, r = np.zeros(z.shape[1]), np.array([ridge] * x.shape[1] + [1e-6]) * max(1.0, len(x) ** 0.5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(r)
        step = np.linalg.solve(h, z.T @ (y - p) - r * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def remainder(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labels(doc_id, toxic) outside remainder 0. Ids labelled twice count as toxic if any label says so.

    Character counts cover all documents. The classifier sees at most fit_rows labelled documents, so its words and
    stems are bounded too; rows with one id are seen one by one. Null ids and labels teach nothing; without both kinds
    of label every text scores the share of toxic ones.
    """
    common.prepare(docs.sparkSession)
    cost = trigrams(docs.select(F.col("text")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", remainder("doc_id").cast("int")).where("fold <> 0")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("text", "toxic", "fold")
    rows = common.materialize(rows.mapInArrow(_words(cost), "words array<string>, toxic int, fold int, text string"), "labelled")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    prior = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    if len(n) < 2:
        return Model(cost, prior, {}, np.array([0, 0, 0, 0, math.log(prior / (1 - prior))]))
    w = F.col("w")
    stems = F.array(F.concat(F.lit("="), w), *(F.when(F.length(w) > k, F.substring(w, 1, k)) for k in STEMS))
    each = rows.select(F.explode("words").alias("w"), "toxic", "fold").select(F.explode(F.array_compact(stems)).alias("f"), "toxic", "fold")
    early = F.when(F.col("fold") < 4, 1).otherwise(0)
    # a text with two words of one stem counts twice for it; that is left so, to keep this one map-side combined sum
    sums = each.groupBy("f").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"), F.sum(early * F.col("toxic")).alias("p0"), F.sum(early).alias("n0"))
    got = sums.where("n >= 5 or (n >= 2 and p >= 2)").collect()
    first = Model(cost, prior, {r["f"]: (r["p0"], r["n0"]) for r in got if r["n0"]}, np.zeros(5))
    fitted = rows.where("fold = 4").select("text", "toxic").mapInArrow(_rows(first), "a double, b double, c double, d double, toxic int").toPandas()
    if fitted["toxic"].nunique() < 2:
        fitted = rows.select("text", "toxic").mapInArrow(_rows(first), "a double, b double, c double, d double, toxic int").toPandas()
    x, y = fitted[["a", "b", "c", "d"]].to_numpy(), fitted["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    weights = _logistic(x[order], y[order])
    return Model(cost, prior, {r["f"]: (r["p"], r["n"]) for r in got}, weights)


def _scores(model: Model) -> Callable:
    def run(batches):
        s = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array([s.score(t.as_py() or "") for t in b.column(b.num_columns - 1)])], names=[*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """carry columns and score of every row, in one narrow pass; a null text counts as empty."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scores(model), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", "score") if "score" not in carry else out


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more, with their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    out = rows.mapInArrow(_scores(model), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.where(F.col("score") < threshold).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, row by row; a null or empty text has a score too, repeated rows have one each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
