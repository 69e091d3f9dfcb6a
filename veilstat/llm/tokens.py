"""Token-ID output: texts to ids of a byte-level BPE, kept as Simple-8b segments in document order, and read back."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, simple8b

#: Ids after which a segment is closed (a longer document still stays in one segment).
SEGMENT_IDS = 1 << 20
#: Distinct chunks whose ids a Python worker remembers.
CACHE_ENTRIES = 900_000
#: Bytes of texts that are encoded together; their distinct chunks are looked up once.
BLOCK_BYTES = 12 << 20
#: Places where the byte-level pre-tokeniser always ends a piece, whatever stands around: before a blank or line end
#: that follows no white space, and before a full stop or comma that follows a Latin letter or digit. Chunks between
#: them can be encoded alone. A text in which each of these four characters stands so is cut without the pattern.
_CUT = re.compile(r"(?<=[^\s])(?=[ \n])|(?<=[a-zA-Z0-9à-öø-ÿ])(?=[.,])")
_UNCUT = re.compile(r"[ \n.,\0](?:(?<=[^a-zA-Z0-9à-öø-ÿ][.,])|(?<=\s[ \n])|(?<=\0))")
#: What _UNCUT finds, for RE2, which has no look-behind and whose white space is that of ASCII.
_UNCUT_RE2 = r"[^a-zA-Z0-9à-öø-ÿ][.,]|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]|\x00"
_WORD = re.compile(r" ?[a-zA-ZÀ-ÖØ-öø-ÿ]+")


def _marked(text: str) -> str:
    """A text that _UNCUT does not find, with a mark at each cut."""
    return text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n")


def chunks(text: str) -> list[str]:
    return _CUT.split(text) if _UNCUT.search(text) else _marked(text).split("\0")


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level model."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_state: dict = {}
SEGMENT_SCHEMA = "part int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


class ChunkEncoder(dict):
    """Ids of whole texts; each distinct chunk is encoded by the tokenizers library once, and its ids' bytes are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.signs = dict(enumerate(_byte_signs()))
        self.word = _WORD if self.tokenizer.normalizer is None else re.compile(" ?[a-zA-Z]+")

    def __missing__(self, chunk: str) -> bytes:
        if self.word.fullmatch(chunk):  # one piece: its bytes' signs go straight to the model
            signs = chunk.replace(" ", "Ġ") if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.signs)
            ids = [t.id for t in self.model.tokenize(signs)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        got = self[chunk] = array("I", ids).tobytes()
        return got

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return b"".join(map(self.__getitem__, chunks(text)))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after the other, and how many each has."""
        texts = texts.fill_null("")
        uncut, held = pc.match_substring_regex(texts, _UNCUT_RE2).to_pylist(), texts.to_pylist()
        if any(u and "\0" in x for u, x in zip(uncut, held)):
            got = [self.encode(x) for x in held]
            return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4
        if len(self) > CACHE_ENTRIES:
            self.clear()
        marked = ["\0".join(_CUT.split(x)) if u else _marked(x) for u, x in zip(uncut, held)]
        parts = pc.split_pattern(pa.array(marked, pa.large_string()), "\0")
        coded = parts.values.dictionary_encode()
        ids = [self[x] for x in coded.dictionary.to_pylist()]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, which = np.cumsum(n) - n, coded.indices.to_numpy()
        each = n[which]
        ends = np.cumsum(each)
        place = np.repeat(first[which] - (ends - each), each)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(ids), "<u4")[place], np.diff(np.concatenate([[0], ends])[parts.offsets.to_numpy()])


def _encoder(path: str) -> ChunkEncoder:
    if path not in _state:
        _state[path] = ChunkEncoder(path)
    return _state[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until their texts have BLOCK_BYTES."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size or held:
        yield pa.Table.from_batches(held)


def _writer(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), _encoder(path)
        segment, before, docs, lens, ids, held = 0, 0, [], [], [], 0

        def flush():
            nonlocal segment, before, docs, lens, ids, held
            values = np.concatenate(ids)
            row = [[part], [segment], [before], [len(values)], [docs], [np.concatenate(lens)], [simple8b.encode(values)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            segment, before, docs, lens, ids, held = segment + 1, before + len(values), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "segment", "before", "n_ids", "doc_ids", "lengths", "payload"])

        for block in _blocks(batches):
            keys = block.column(0).to_pylist()
            own, n = enc.encode_all(block.column(1).combine_chunks())
            ends = np.cumsum(n + 1)
            values = np.full(len(own) + len(n), end_id, own.dtype)
            is_id = np.ones(len(values), bool)
            is_id[ends - 1] = False
            values[is_id] = own
            at = 0
            while at < len(keys):
                done = int(ends[at - 1]) if at else 0
                z = min(len(keys), int(np.searchsorted(ends, done + SEGMENT_IDS - held)) + 1)
                docs += keys[at:z]
                lens.append(n[at:z] + 1)
                ids.append(values[done : ends[z - 1]])
                held += int(ends[z - 1]) - done
                at = z
                if held >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, out: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes docs in ascending id order and writes segments to the folder out; returns it.

    Texts are dealt by ranges of the id and sorted there, so each task writes the segments of one id range and no
    range depends on a key's frequency except for rows that share one id. Null texts count as empty, null ids come
    first, rows of one id stand by a hash of their texts. A segment row holds its documents' ids and lengths and a Simple-8b payload.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_writer(tokenizer_path, end_id), SEGMENT_SCHEMA).write.parquet(out)
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, docs, lens, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
            ids = simple8b.decode(payload).astype("<u4")
            ends = np.cumsum(lens)
            begins = ends - lens
            crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(begins, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + base), pa.array(np.asarray(lens, np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a folder of write_ids(): doc_id, start, n_tokens, ids_crc32."""
    common.prepare(spark)
    seg = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    base, rows = 0, []
    for r in seg.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row per written task
        rows.append((r["part"], base))
        base += r["n"]
    offsets = spark.createDataFrame(rows, "part int, base long")
    seg = seg.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("base")).alias("b"), "doc_ids", "lengths", "payload")
    return seg.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for docs, lens, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
            ids = simple8b.decode(payload).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))], names=["doc_id", "ids"])


def read_id_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The ids themselves: doc_id, ids array<long>."""
    common.prepare(spark)
    return spark.read.schema(SEGMENT_SCHEMA).parquet(folder).select("doc_ids", "lengths", "payload").mapInArrow(_flat, "doc_id long, ids array<long>")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through the byte-level BPE to Simple-8b files and back."""
    import public_tokenizers

    out = f"{common.shared_dir(spark)}/veil-ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 2, out)
    return read_ids(spark, out)
