"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking over longest matches.

A sequence of pieces is what merging gives exactly if merging gives back each piece by itself and each two neighbours
by themselves. So a text is encoded left to right: take the longest piece that matches (all matches of a text come from
one Aho-Corasick pass), fall back to shorter ones where a neighbour is not compatible, and step back where none is left;
a bitfield remembers places from which no way leads on. Compatibility is decided by re-merging the two pieces, once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Distinct chunks, and pairs of pieces, whose results a Python worker remembers.
CACHE_ENTRIES, CACHE_PAIRS = 500_000, 1_000_000
_LETTER = "a-zA-Zà-öø-ÿ"
_state: dict = {}


class PieceCodec:
    """Encodes and decodes whole texts like the library does without begin and end ids and without sampling.

    For models of type BPE with byte fallback, the identity normaliser and a dummy prefix; others are refused.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes, self.id, self.score, self.piece = [0] * 256, {}, {}, [""] * n
        for i in range(n):
            p = self.piece[i] = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.id[p], self.score[p] = i, sp.get_score(i)
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        probe = "é  xﬁ \t\u0001"
        if not any(self.bytes) or sp.decode(sp.encode(probe)) != probe:
            raise ValueError("not a byte-fallback model with the identity normaliser")
        inner = {c for p in self.id for c in p if len(p) > 1}
        self.odd = {c for c in inner if c not in self.id}
        # No piece holds these two characters side by side, so nothing merges across: chunks end there.
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        if any(q[1] == SPACE and q[0] != SPACE for q in pairs):
            raise ValueError("pieces that go on over a space are not supported")
        letters = re.compile(f"[{_LETTER}]")
        stops = [y for y in ".,;:!?|\"'()$%&*#-" if not any(q[1] == y and letters.match(q[0]) for q in pairs)]
        cut = rf"(?<=[^{SPACE}])(?={SPACE})"
        if stops:
            cut += rf"|(?<=[{_LETTER}])(?=[{re.escape(''.join(stops))}])"
        if not any("\n" in q for q in pairs):
            cut += r"|(?<=\n)(?=[\s\S])|(?=\n)"
        self.cut = re.compile(cut).split
        auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            if SPACE * 2 not in p and self.merge(p) == [i]:
                auto.add_word(p, i)
        auto.make_automaton()
        self.matches, self.length, self.pairs = auto.iter, [len(p) for p in self.piece], {}
        self.known_ids: dict[str, str] = {}
        self.known_text: dict[str, str] = {}

    def merge(self, text: str) -> list[int]:
        """The plain definition: merge the best-scored neighbours, leftmost first, until none is a piece."""
        sym, left, right = list(text), list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        score, heap = self.score, []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := score.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-s, a, b, sym[a] + sym[b]))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if right[a] != b or not sym[a] or sym[a] + sym[b] != both:
                continue
            sym[a], sym[b], right[a] = both, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out: list[int] = []
        for s in sym:
            if s:
                i = self.id.get(s)
                out.extend([i] if i is not None else [self.bytes[x] for x in s.encode()])
        return out

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return got

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk (the dummy prefix and spaces already in place)."""
        if SPACE * 2 in text or self.odd and not self.odd.isdisjoint(text):
            return self.merge(text)  # runs of spaces tie in score, so neighbours alone don't decide
        n, length = len(text), self.length
        at: list[list[int]] = [[] for _ in range(n)]
        for end, i in self.matches(text):
            at[end + 1 - length[i]].append(i)
        if [] not in at:
            return self._walk(text, at)
        out: list[int] = []
        k = 0
        while k < n:  # characters outside the vocabulary become bytes, and nothing merges with them
            j, known = k, bool(at[k])
            while j < n and bool(at[j]) == known:
                j += 1
            out.extend(self._walk(text[k:j], at[k:j]) if known else map(self.bytes.__getitem__, text[k:j].encode()))
            k = j
        return out

    def _walk(self, text: str, at: list[list[int]]) -> list[int]:
        """Ids of a stretch; at holds the pieces that match at each place, shortest first."""
        n, length = len(text), self.length
        dead = bytearray(n + 1)
        out: list[int] = []
        kept: list[int] = []
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            here, last = at[pos], out[-1] if out else -1
            while k >= 0:
                t = here[k]
                if not dead[pos + length[t]] and (last < 0 or self.fits(last, t)):
                    break
                k -= 1
            if k >= 0:
                out.append(t)
                kept.append(k)
                pos += length[t]
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                if not out:
                    return self.merge(text)
                t = out.pop()
                pos, k = pos - length[t], kept.pop() - 1
        return out

    def text_of(self, ids: list[int]) -> str:
        """What ids decode to, with spaces, before the dummy prefix goes; bytes that are no UTF-8 become U+FFFD."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held = bytearray()
            out.append(self.piece[i])
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def parts(self, text: str) -> list[str]:
        """A text as chunks between which nothing merges."""
        if not text:
            return []
        parts = self.cut(SPACE + text.replace(" ", SPACE))
        ids, back = self.known_ids, self.known_text
        if len(ids) > CACHE_ENTRIES:
            ids.clear()
            back.clear()
        for p in parts:
            if p not in ids:
                got = self.chunk(p)
                ids[p], back[p] = ",".join(map(str, got)), self.text_of(got)
        return parts

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in self.known_ids[p].split(",") if i]

    def both(self, text: str) -> tuple[str, str]:
        """The ids as decimal numbers joined by commas, and the text that they decode to."""
        parts = self.parts(text)
        return ",".join(map(self.known_ids.__getitem__, parts)), "".join(map(self.known_text.__getitem__, parts))[1:]


def codec(path: str) -> PieceCodec:
    if path not in _state:
        _state[path] = PieceCodec(path)
    return _state[path]


def _digests(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                ids, text = c.both(x.as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        # the worker lives on under other operators of the session: its memory is theirs too
        c.known_ids.clear()
        c.known_text.clear()

    return run


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with a column of ids; narrow, no shuffle. Null and empty texts have no ids."""
    common.prepare(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        c = codec(model_path)
        return texts.map(lambda x: c.encode(x or ""))

    ids.func.__annotations__.clear()
    return docs.withColumn(out_col, ids(F.col(text_col)))


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids (decimal, comma-joined) and of the decoded text.

    One narrow pass; memory is bounded by a batch of texts and the caches. A null text counts as empty: no ids, empty
    text. Repeated rows and null ids stay as rows of their own.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through the 32k merge-type model and back."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
