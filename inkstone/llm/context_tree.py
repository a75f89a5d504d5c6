"""Context-tree weighting over bytes.

A byte is eight binary decisions. Each decision has a context tree whose nodes are the last 0 .. DEPTH bytes; a node has a
Krichevsky-Trofimov estimate of its bit from the training counts and is weighted half against the product of its longer
contexts. The weights of all depths give the probability of a byte behind DEPTH bytes, so a text costs the sum over its
byte runs. Scored is the text in lower case (A-Z), with one end byte.

Runs of DEPTH + 1 bytes are counted per block of documents; counts are summed by run, trees are built by shards of the last two
context bytes, and the probabilities return to the blocks that asked for them. A block is a run of documents of one scan
task; its documents are written once, compressed, and meet their probabilities by the number of the block.

Defined cases: a null text is an empty text; a null id counts as an empty id for the fold; repeated rows keep a row each;
without training texts every bit has probability 1/2 and the base is log10(0.1 / 0.1).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import SLICE_CHARS, id_remainder, slices, store

DEPTH = 5
#: A byte that UTF-8 never uses stands before and after every text.
EDGE = b"\xff"
#: Size of a block in UTF-8 bytes: large ones ask for fewer runs in all. A task holds the runs of a block, and one piece of its texts.
BLOCK_CHARS = 32_000_000
PIECE_BYTES = 1_000_000
END_WORD = -1
HALF = math.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma by Stirling's series from x + 8 on."""
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - math.log(math.pi) - lgamma(n0 + n1 + 1.0)


def runs(data: bytes) -> np.ndarray:
    """Codes of the bytes behind DEPTH others: last byte of context first, the byte itself lowest."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    code = a[DEPTH:].copy()
    for i in range(1, DEPTH + 1):
        code |= a[DEPTH - i:len(a) - i] << 8 * (DEPTH + 1 - i)
    return code


def pieces(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, codes, text of each code) of some texts at a time; a very long text comes alone."""
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at + len(held) < len(texts) and (not held or size + len(texts[at + len(held)]) <= PIECE_BYTES):
            held.append(texts[at + len(held)])
            size += len(held[-1])
        code = runs(b"".join(EDGE * DEPTH + t + EDGE for t in held))
        lengths = np.array([len(t) + 1 for t in held])
        # between two texts stand the runs whose last byte is one of the next text's DEPTH edge bytes
        gaps = np.repeat(np.arange(len(held)), lengths) * DEPTH + np.arange(lengths.sum())
        yield at, code[gaps], np.repeat(np.arange(len(held)), lengths)
        at += len(held)


def word_key(word: bytes) -> int:
    """Keys of words are negative, codes of byte runs are not."""
    return xxhash.xxh3_64_intdigest(word) >> 1 | -(1 << 63)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, docs): the rows in compressed pieces; the pieces of a block follow one another."""
    task, number, size = TaskContext.get().partitionId(), 0, 0
    for piece in slices(batches, chars=min(SLICE_CHARS, BLOCK_CHARS)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(piece)
        if size and size + piece.column("text").nbytes > BLOCK_CHARS * 5 // 4:
            number, size = number + 1, 0
        size += piece.column("text").nbytes
        yield pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])


def unpack(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(docs).read_all()


def lowered(table: pa.Table) -> list[bytes]:
    return [(t or "").encode().lower() for t in table.column("text").to_pylist()]


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, n): every run and word of a block's documents, with its count in the training ones.

    A block whose pieces are read by two tasks asks for some keys twice; its counts are parts then.
    """
    rows = ((b, d) for batch in batches for b, d in zip(batch.column("block").to_pylist(), batch.column("docs")))
    for block, held in groupby(rows, key=lambda r: r[0]):
        keys, counts = counted(unpack(d.as_py()) for _, d in held)
        for at in range(0, len(keys), 100_000):
            k = keys[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k), pa.array(counts[at:at + 100_000])], names=["block", "key", "n"])


def counted(tables: Iterator[pa.Table]) -> tuple[np.ndarray, np.ndarray]:
    """Every run and word of some documents, with its count in the training ones."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    trained = 0
    for table in tables:
        texts = lowered(table)
        train = np.array(table.column("train").to_pylist(), bool)
        trained += int(train.sum())
        for at, code, text in pieces(texts):
            # one sort serves the runs and their training counts: the lowest bit says training
            both = np.sort(code << 1 | train[at + text])
            first = np.flatnonzero(np.concatenate([[True], both[1:] >> 1 != both[:-1] >> 1]))
            parts.append((both[first] >> 1, np.add.reduceat(both & 1, first)))
            if len(parts) > 4:
                parts = [merge_counts(parts)]
        # words are kept as keys too, so only a piece's words are strings
        words: Counter[bytes] = Counter()
        for t, learn in zip(texts, train):
            if learn:
                words.update(t.split())
            else:
                for w in t.split():
                    words.setdefault(w, 0)
        parts.append((np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))))
    keys, counts = merge_counts(parts)
    return np.append(keys, END_WORD), np.append(counts, trained)


def level(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, n0, n1) of the trees at one depth: node = context * 256 + (1, bits decided so far)."""
    code, back = np.unique((keys >> 8 * (DEPTH + 1 - depth) << 8) | (keys & 255), return_inverse=True)
    n = np.bincount(back, n, len(code))
    x = code & 255
    node = np.concatenate([(code & ~255) | (1 << j) | (x >> 8 - j) for j in range(8)])
    bit = np.concatenate([x >> 7 - j & 1 for j in range(8)])
    nodes, back = np.unique(node, return_inverse=True)
    both = np.tile(n, 8)
    return nodes, np.bincount(back, both * (1 - bit), len(nodes)), np.bincount(back, both * bit, len(nodes))


def up(node: np.ndarray) -> np.ndarray:
    """The node with the oldest context byte left out."""
    return (node >> 16 << 8) | (node & 255)


class Tree:
    """Nodes of the depths ``top`` .. DEPTH for some runs: counts, and log weights of the KT estimate against longer contexts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, top: int):
        self.top = top
        self.nodes, self.n0, self.n1, self.alpha, weighted = {}, {}, {}, {}, None
        for d in range(DEPTH, top - 1, -1):
            nodes, n0, n1 = level(keys, n, d)
            kt = log_kt(n0, n1)
            if d == DEPTH:
                w, alpha = kt, np.ones(len(nodes))
            else:
                w, alpha = weigh(kt, children(nodes, *weighted))
            weighted = (nodes, w)
            self.nodes[d], self.n0[d], self.n1[d], self.alpha[d] = nodes, n0, n1, alpha
        self.root = weighted

    def mix(self, keys: np.ndarray, p: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Probability of each bit (8 x keys), from the longest contexts up to ``top``; ``p`` goes on from a deeper tree's result."""
        x = keys & 255
        bit = np.stack([x >> 7 - j & 1 for j in range(8)])
        heap = np.stack([(1 << j) | (x >> 8 - j) for j in range(8)])
        out = np.full(bit.shape, 0.5) if p is None else p
        for d in sorted(self.nodes, reverse=True):
            if not len(self.nodes[d]):  # nothing learned at all: 1/2 stays
                continue
            want = (keys >> 8 * (DEPTH + 1 - d) << 8)[None, :] | heap
            at, hit = find(self.nodes[d], want)
            n0, n1 = np.where(hit, self.n0[d][at], 0.0), np.where(hit, self.n1[d][at], 0.0)
            kt = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
            alpha = np.where(hit, self.alpha[d][at], 1.0 if d == DEPTH else 0.5)
            out = alpha * kt + (1 - alpha) * out
        return out


def find(known: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(want.shape, np.int64), np.zeros(want.shape, bool)
    at = np.searchsorted(known, want)
    at[at == len(known)] = 0
    return at, known[at] == want


def children(nodes: np.ndarray, deeper: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the log weights of each node's longer contexts."""
    return np.bincount(np.searchsorted(nodes, up(deeper)), weight, len(nodes))


def weigh(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.logaddexp(HALF + kt, HALF + below)
    return w, np.exp(HALF + kt - w)


class Top:
    """Depths 0 and 1, at most 257 * 255 nodes, from counts by (last byte, byte) and the weights of depth 2."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, deeper: np.ndarray, weight: np.ndarray):
        keys = (pairs >> 8 << 8 * DEPTH) | (pairs & 255)
        self.tree = Tree.__new__(Tree)
        self.tree.nodes, self.tree.n0, self.tree.n1, self.tree.alpha = {}, {}, {}, {}
        for d in (1, 0):
            nodes, n0, n1 = level(keys, n, d)
            below = np.zeros(len(nodes))
            below[:] = np.bincount(np.searchsorted(nodes, deeper), weight, len(nodes))
            w, alpha = weigh(log_kt(n0, n1), below)
            self.tree.nodes[d], self.tree.n0[d], self.tree.n1[d], self.tree.alpha[d] = nodes, n0, n1, alpha
            deeper, weight = up(nodes), w


def shards(counts: DataFrame) -> DataFrame:
    """Runs dealt so that all contexts that share their last two bytes are in one task."""
    return counts.where("key >= 0").repartition(F.shiftright("key", 8 * (DEPTH - 1)))


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    got = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
    return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.empty(0, np.int64), np.empty(0, np.int64))


def probabilities(counts: DataFrame) -> DataFrame:
    """(key, value): natural log probability of the last byte of every run of ``counts`` (key, n), with n = 0 for runs only asked for."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _whole(batches)
        keys, n = keys[n > 0], n[n > 0]
        if len(keys):
            nodes, w = Tree(keys, n, 2).root
            node, back = np.unique(up(nodes), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.bincount(back, w, len(node)))], names=["node", "w"])

    below = shards(counts).mapInArrow(roots, "node long, w double").groupBy("node").agg(F.sum("w").alias("w")).orderBy("node").toArrow()
    pair = F.shiftleft(F.shiftright("key", 8 * DEPTH), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255).cast("long")))
    pairs = counts.where("key >= 0 AND n > 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    top = Top(pairs.column("pair").to_numpy(), pairs.column("n").to_numpy(), below.column("node").to_numpy(), below.column("w").to_numpy())
    shared = counts.sparkSession.sparkContext.broadcast(top)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _whole(batches)
        tree = Tree(keys[n > 0], n[n > 0], 2) if (n > 0).any() else None
        for at in range(0, len(keys), 100_000):
            k = keys[at:at + 100_000]
            p = shared.value.tree.mix(k, tree.mix(k) if tree else None)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.log(p).sum(axis=0))], names=["key", "value"])

    return shards(counts).mapInArrow(predict, "key long, value double")


def answer(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Scores of a block's documents from the values of its runs and words."""
    order = np.argsort(known.column("key").to_numpy())
    keys, values = known.column("key").to_numpy()[order], known.column("value").to_numpy()[order]
    first = np.searchsorted(keys, 0)
    end = int(np.searchsorted(keys[:first], END_WORD))
    return pa.concat_tables(_answer(unpack(d.as_py()), keys, values, first, end) for d in docs.column("docs"))


def _answer(docs: pa.Table, keys: np.ndarray, values: np.ndarray, first: int, end: int) -> pa.Table:
    run_keys, run_values = keys[first:], values[first:]
    texts = lowered(docs)
    score = np.zeros(len(texts))
    for at, code, text in pieces(texts):
        # in ascending order the search walks the table once
        order = np.argsort(code)
        where, hit = find(run_keys, code[order])
        if not hit.all():
            raise ValueError("a byte run of a block has no probability")
        value = np.empty(len(code))
        value[order] = run_values[where]
        score[at:at + text[-1] + 1] = np.bincount(text, value, text[-1] + 1)
    held = dict.fromkeys(chain.from_iterable(t.split() for t in texts))
    held = dict(zip(held, np.searchsorted(keys[:first], np.fromiter(map(word_key, held), np.int64, len(held))).tolist()))
    n_tokens, n_known, base = [], [], []
    for t in texts:
        ws = t.split()
        at = np.fromiter(map(held.__getitem__, ws), np.int64, len(ws))
        c = values[np.append(at, end)]
        n_tokens.append(len(c))
        n_known.append(int((c > 0).sum()))
        base.append(float(np.log10(c + 0.1).sum()))
    return pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                     "base": pa.array(base, pa.float64()), "score": pa.array(score / math.log(10))})


def score(docs: DataFrame, train: F.Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of whole texts, learning from the rows where ``train`` holds."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    d = store(src.coalesce(max(1, -(-int(size) // BLOCK_CHARS))).mapInArrow(pack, "block long, docs binary"), "blocks")
    wanted = store(d.mapInArrow(asked, "block long, key long, n long"), "wanted", "zstd")
    counts = store(wanted.groupBy("key").agg(F.sum("n").alias("n")), "counts", "zstd")
    n, v = counts.where("key < 0 AND n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    values = probabilities(counts).unionByName(counts.where("key < 0").select("key", F.col("n").cast("double").alias("value")))
    known = wanted.select("block", "key").join(store(values, "values", "zstd"), "key")
    kinds = "doc_id long, train boolean, n_tokens long, n_known long, base double, score double"
    out = d.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(answer, kinds)
    total = math.log10(n + 0.1 * (v + 1))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score")


def cross_validated(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    return score(docs, id_remainder("doc_id", folds) != held)
