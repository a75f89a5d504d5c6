"""Token-id files of patched frame-of-reference blocks.

A file is a folder of Parquet parts whose rows are segments: whole documents in ascending id order, their ids packed in
blocks of 128. Of each block the minimum is subtracted and the rest packed at the width that a percentile of its values
needs; wider values are exceptions with position and high bits. ``starts`` indexes the first byte of each block, so one
block can be read without those before it. Spark's writer commits parts whole, so a lost executor leaves no half file.

Defined cases: a null text is an empty text (its document holds the end id alone); rows of a null id sort first;
repeated rows are documents of their own; an empty table gives an empty folder with its schema.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.common import no_collection, slices
from inkstone.llm.token_counts import byte_alphabet
from inkstone.session import shared_dir

BLOCK = 128
PERCENTILE = 90
#: Ids of a segment; a longer document is a segment of its own.
SEGMENT = 1 << 18
#: Words, and parts of words, that a worker remembers: about 200 bytes each.
CACHE = 1_000_000
ENDS = frozenset(".,;:!?")
#: Words that need no normalisation but lower case, and the parts the vocabulary's pattern cuts them in.
PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
FORMAT = "part int, first long, doc_ids array<long>, lengths array<long>, starts binary, payload binary"
HEAD = struct.Struct("<IBBB")  # minimum, width, exceptions, values


def encode_blocks(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, starts) of unsigned 32-bit ids. A block is its head, the packed values, exception positions, exception high bits."""
    n = len(ids)
    if not n:
        return b"", b""
    count = -(-n // BLOCK)
    x = np.full(count * BLOCK, ids[-1], np.uint32)
    x[:n] = ids
    x = x.reshape(count, BLOCK)
    low = x.min(axis=1)
    rest = x - low[:, None]
    ordered = np.partition(rest, (BLOCK * PERCENTILE) // 100, axis=1)[:, (BLOCK * PERCENTILE) // 100]
    width = np.ceil(np.log2(ordered.astype(np.float64) + 1)).astype(np.int64)
    over = np.where(width[:, None] < 32, rest >> np.minimum(width, 31).astype(np.uint32)[:, None], np.uint32(0))
    row, col = np.nonzero(over)
    wrong = np.bincount(row, minlength=count)
    sizes = HEAD.size + BLOCK // 8 * width + 5 * wrong
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(count, 4)
    out[starts + 4], out[starts + 5], out[starts + 6] = width, wrong, BLOCK
    out[starts[-1] + 6] = n - BLOCK * (count - 1)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[(starts[at] + HEAD.size)[:, None] + np.arange(BLOCK // 8 * w)] = pack_bits(rest[at], int(w))
    place = (starts + HEAD.size + BLOCK // 8 * width)[row]
    rank = np.arange(len(row)) - np.repeat(np.cumsum(wrong) - wrong, wrong)
    out[place + rank] = col
    out[(place + wrong[row] + 4 * rank)[:, None] + np.arange(4)] = over[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype("<u4").tobytes()


def pack_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, row by row, as bytes."""
    if not width:
        return np.empty((len(rows), 0), np.uint8)
    raw = np.ascontiguousarray(rows.astype("<u4")).view(np.uint8).reshape(len(rows), rows.shape[1], 4)
    bits = np.unpackbits(raw, axis=2, bitorder="little", count=32)[:, :, :width]
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")


def unpack_bits(data: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(data), BLOCK), np.uint32)
    bits = np.unpackbits(data, axis=1, bitorder="little").reshape(len(data), BLOCK, width)
    full = np.zeros((len(data), BLOCK, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full.reshape(len(data), -1), axis=1, bitorder="little").view("<u4").reshape(len(data), BLOCK)


def decode_blocks(payload: bytes, starts: bytes) -> np.ndarray:
    at = np.frombuffer(starts, "<u4").astype(np.int64)
    if not len(at):
        return np.empty(0, np.uint32)
    data = np.frombuffer(payload, np.uint8)
    heads = [HEAD.unpack_from(payload, a) for a in at]
    low, width, wrong, values = (np.array(c) for c in zip(*heads))
    out = np.empty((len(at), BLOCK), np.uint32)
    body = at + HEAD.size
    for w in np.unique(width):
        k = np.flatnonzero(width == w)
        size = BLOCK * int(w) // 8
        out[k] = unpack_bits(data[body[k][:, None] + np.arange(size)], int(w))
    for k in np.flatnonzero(wrong):
        a = body[k] + BLOCK * int(width[k]) // 8
        m = int(wrong[k])
        where = data[a:a + m]
        high = np.frombuffer(payload, "<u4", m, int(a) + m)
        out[k, where] |= high << np.uint32(width[k])
    out += low.astype(np.uint32)[:, None]
    return np.concatenate([out[:-1].ravel(), out[-1, :values[-1]]])


class WordIds:
    """Ids of whole words of one vocabulary file; white space separates them and has no ids itself.

    Words of Latin letters, digits and ASCII marks are cut here, as the file's pattern does, and each distinct part goes
    to the model once; all other words go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.letters = {b: c for c, b in byte_alphabet().items()}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            mapped = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return ids

    def learn(self, new: set[str]) -> None:
        if len(self.parts) > CACHE:
            self.parts.clear()
        whole = []
        for w in new:
            if w.isascii() and w.isalpha():
                self.known[w] = self.part(w.lower())
            elif w[-1] in ENDS and w[:-1].isascii() and w[:-1].isalpha():  # as the pattern cuts it
                self.known[w] = self.part(w[:-1].lower()) + self.part(w[-1])
            elif PLAIN.fullmatch(w) and "<|" not in w:
                low = w.lower()
                self.known[w] = self.part(low) if low.isalpha() else b"".join([self.part(p) for p in PARTS.findall(low)])
            else:
                whole.append(w)
        for at in range(0, len(whole), 20_000):
            some = whole[at:at + 20_000]
            for w, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False)):
                self.known[w] = array("I", e.ids).tobytes()

    def texts(self, texts: list[str], end: int) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*cut)
        if len(self.known) + len(words) > CACHE:
            self.known = {"": b""}
        self.learn({w for w in words if w not in self.known})
        get, tail = self.known.__getitem__, array("I", [end]).tobytes()
        return [b"".join(map(get, row)) + tail for row in cut]


_WORDS: dict[str, WordIds] = {}


def words(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def write(docs: DataFrame, vocabulary: str, end: int, folder: str) -> None:
    """Encode ``docs`` in ascending doc_id order and write the folder; ``first`` is a segment's start within its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, ids, buffers, held = TaskContext.get().partitionId(), 0, [], [], 0
        w = words(vocabulary)

        def segment() -> pa.RecordBatch:
            payload, starts = encode_blocks(np.frombuffer(b"".join(buffers), "<u4"))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(b) // 4 for b in buffers]], pa.list_(pa.int64())), pa.array([starts], pa.binary()), pa.array([payload], pa.binary())],
                names=["part", "first", "doc_ids", "lengths", "starts", "payload"])

        for b in slices(batches):
            with no_collection():
                encoded = w.texts([t or "" for t in b.column("text").to_pylist()], end)
            for doc, data in zip(b.column("doc_id").to_pylist(), encoded):
                if buffers and held + len(data) // 4 > SEGMENT:
                    yield segment()
                    first, ids, buffers, held = first + held, [], [], 0
                ids.append(doc)
                buffers.append(data)
                held += len(data) // 4
        if buffers:
            yield segment()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(src.sparkSession.sparkContext.defaultParallelism, src.rdd.getNumPartitions())
    src.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, FORMAT).write.parquet(folder)


def read(spark: SparkSession, folder: str, schema: str, fn) -> DataFrame:
    """Rows ``fn(doc_ids, starts of the documents, ids of the documents)`` of every segment of a folder.

    Where a part starts follows from the lengths of the parts before it: one small row per part.
    """
    rows = spark.read.schema(FORMAT).parquet(folder)
    sizes = rows.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    offset = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "payload"):
            for r in b.to_pylist():
                ids = decode_blocks(r["payload"], r["starts"])
                ends = np.cumsum(r["lengths"])
                pieces = np.split(ids, ends[:-1])
                start = r["first"] + r["offset"] + ends - np.array(r["lengths"])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in fn(r["doc_ids"], start, pieces)], names=names)

    return rows.join(offset, "part").mapInArrow(run, schema)


def ids_of(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files."""
    return read(spark, folder, "doc_id long, start long, ids array<long>", lambda docs, start, pieces: (
        pa.array(docs, pa.int64()), start, pa.array([p.astype(np.int64) for p in pieces], pa.list_(pa.int64()))))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda docs, start, pieces: (
        pa.array(docs, pa.int64()), start, pa.array([len(p) for p in pieces], pa.int64()),
        pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in pieces], pa.int64())))


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
