"""Benchmark decontamination by q-gram lemma filtering.

Benchmark texts are cut into overlapping pieces. A document region that holds a piece of m characters with at most k
edits shares at least m + 1 - q (k + 1) of its q-grams with it, within diagonals that differ by at most k. So shared
q-grams are counted in bands of 2k + 1 diagonals that overlap by k + 1; bands that reach the bound are verified by alignment in
the band, and their documents leave the corpus.

The benchmark is indexed in blocks of at most INDEX_CHARS characters; a block, and no more, is on the driver and in a task.

Defined cases: texts are compared in lower case with white space as single spaces; null benchmark items and
those shorter than MIN_PIECE characters match nothing; null texts are clean; rows of a null id are judged
like others; repeated rows keep a row each; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import slices, store

Q = 8
PIECE, STEP, MIN_PIECE = 64, 32, 24
#: Edits that a piece may have, per cent of its length.
EDITS = 9
INDEX_CHARS = 4_000_000
FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def squash(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of the Q characters from each place on, of two halves that are hashed alike; Q is a power of two."""
    if len(x) < Q:
        return np.empty(0, np.uint64)
    h, step = x.astype(np.uint64), 1
    while step < Q:
        left = h[:-step] * _MIX
        left += h[step:]
        left ^= left >> np.uint64(29)
        h, step = left, 2 * step
    h *= _MIX
    return h


class Index:
    """Pieces of a block of the benchmark and where their q-grams stand."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.text = [], []
        for item, text in items:
            t = squash(text)
            if len(t) < MIN_PIECE:
                continue
            starts = list(range(0, max(1, len(t) - PIECE + 1), STEP))
            if starts[-1] + PIECE < len(t):
                starts.append(len(t) - PIECE)
            for s in starts:
                self.item.append(item)
                self.text.append(t[s:s + PIECE])
        self.points = [points(t) for t in self.text]
        grams = [qgrams(p) for p in self.points]
        key = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        piece = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.piece, self.at = piece[order].astype(np.int64), at[order].astype(np.int64)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[key >> np.uint64(64 - FILTER_BITS)] = True
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.edits = self.length * EDITS // 100
        self.need = np.maximum(1, self.length + 1 - Q * (self.edits + 1))
        self.least = int(self.need.min()) if len(self.need) else 1
        self.reach = int((self.length + 2 * self.edits).max()) if len(self.need) else 0

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """(piece, first diagonal) of the bands of a text that hold enough shared q-grams."""
        h = qgrams(x)
        where = np.flatnonzero(self.maybe[h >> np.uint64(64 - FILTER_BITS)])
        if len(where) < self.least:
            return np.empty((0, 2), np.int64)
        k = np.searchsorted(self.key, h[where])
        k[k == len(self.key)] = 0
        ok = self.key[k] == h[where]
        where, k = where[ok], k[ok]
        # a band's q-grams start within a piece and its edits: places without enough of them nearby are skipped
        if len(where) < self.least:
            return np.empty((0, 2), np.int64)
        left = where[: len(where) - self.least + 1]
        dense = where[self.least - 1:] - left <= self.reach
        cover = np.zeros(len(where) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(dense), 1)
        np.add.at(cover, np.flatnonzero(dense) + self.least, -1)
        pick = np.cumsum(cover)[:-1] > 0
        where, k = where[pick], k[pick]
        n = self.first[k + 1] - self.first[k]
        if not n.sum():
            return np.empty((0, 2), np.int64)
        entry = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        piece, diagonal = self.piece[entry], np.repeat(where, n) - self.at[entry]
        wide = self.edits[piece] + 1
        band = np.floor_divide(diagonal, wide)
        # a band starts every k + 1 diagonals and is 2k + 1 wide: each hit falls in up to two
        # piece and band in one number: bands lie between -2**32 and 2**32
        one = (piece << 33) + band + (1 << 32)
        keys, count = np.unique(np.concatenate([one, one - 1]), return_counts=True)
        piece, band = keys >> 33, (keys & (1 << 33) - 1) - (1 << 32)
        enough = count >= self.need[piece]
        piece, band = piece[enough], band[enough]
        return np.stack([piece, band * (self.edits[piece] + 1)], 1)

    def items(self, text: str | None) -> list[int]:
        """Ids of the items of which a piece stands in the text."""
        x = points(squash(text))
        if len(x) < Q or not len(self.key):
            return []
        found: set[int] = set()
        for piece, diagonal in self.candidates(x).tolist():
            if self.item[piece] not in found and aligned(self.points[piece], x, diagonal, int(self.edits[piece])):
                found.add(self.item[piece])
        return sorted(found)


def aligned(p: np.ndarray, x: np.ndarray, diagonal: int, k: int) -> bool:
    """Whether ``p`` stands in ``x`` with at most ``k`` edits, starting on one of the band's diagonals and staying within k of them."""
    width = 4 * k + 2
    base = diagonal - k
    cost = np.zeros(width, np.int64)  # free start: cost[c] belongs to place base + c of the text
    place = base + np.arange(width)
    cost[(place < 0) | (place > len(x))] = 1 << 20
    offset = np.arange(width)
    for i in range(len(p)):
        at = place + i
        inside = (at >= 0) & (at < len(x))
        same = np.zeros(width, bool)
        same[inside] = x[at[inside]] == p[i]
        step = np.minimum(np.where(inside, cost + ~same, 1 << 20), np.append(cost[1:], 1 << 20) + 1)
        # insertions run along the row: the least of step[j] + (c - j)
        cost = np.minimum.accumulate(step - offset) + offset
    return bool(cost.min() <= k)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, items) a row per row of ``docs``: ids of the benchmark items of which it holds a piece."""
    sized = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // INDEX_CHARS))
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = src.withColumn("items", F.array().cast("array<long>"))
    for k in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index([(r.item_id, r.text) for r in part.orderBy("item_id", "text").toLocalIterator()])
        found = scan(found, index)
        if blocks > 1:  # what this block matched is written before the next block is read
            found = store(found, "matches")
    return found.select("doc_id", F.array_sort(F.array_distinct("items")).alias("items"))


def scan(rows: DataFrame, index: Index) -> DataFrame:
    """Add the items of one block to the rows (doc_id, text, items)."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in slices(batches):
            items = [old + ix.items(t) for old, t in zip(b.column("items").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "items"])

    return rows.mapInArrow(run, "doc_id long, text string, items array<long>")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_items, items, kept): ``kept`` is false for documents that hold a piece of the benchmark."""
    return matches(docs, benchmark).select("doc_id", F.size("items").cast("long").alias("n_items"), "items", (F.size("items") == 0).alias("kept"))
