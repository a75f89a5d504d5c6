"""Ranked lexical search: the best documents of every query item, by a dual tree over items and documents.

A document is a vector of term saturations, an item one of term weights times repeats, both without negative numbers,
and a score is their product. Both sides get a hierarchy whose nodes hold the coordinate maxima of what is below, so
the product of two nodes' maxima bounds every score between them. A pair of nodes goes as a whole when the bound is
under the weakest kth score of its items, or equals it while all its ids come later; pairs that remain are opened on
both sides down to leaves, where scores are exact whole numbers. Weakest scores start from an exact ranking of a
bounded sample of the documents, which only spares work: every document is searched.

Documents are read once for each block of items, into a stored forward index of the block's terms; each task searches
its documents in blocks and returns the best of each item.

Defined cases: a null or term-free document or item matches nothing and does not count; items that repeat with the
same id and text are one item, texts of one id are ranked apart; repeated documents take a rank each, a null doc_id
comes last among equal scores. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import no_collection, slices, store

ITEM_CHARS = 1_000_000  # characters of a block of items; one longer item is a block of its own
NUMBERS = 4_000_000  # numbers of a dense table of maxima or weights
ITEMS = 512  # items searched together
ITEM_LEAF, DOC_LEAF, FAN = 8, 32, 8
DOCS, POSTINGS = 8192, 2_000_000  # of a block of documents
SAMPLE = 16_384  # documents that give the first weakest scores
SETTLE = 200_000  # found pairs before they are ranked
LAST = np.iinfo(np.int64).max  # stands for a null id

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split(b" ") if text else []


def counted(text: str | None) -> Counter:
    got = Counter(terms(text))
    got.pop(b"", None)
    return got


def saturation(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 75 + (25 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def levels(rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Coordinate maxima from the leaves, runs of ``leaf`` rows, up to one root; a parent covers ``FAN`` nodes."""
    out, step = [], leaf
    while True:
        rows = np.maximum.reduceat(rows, np.arange(0, len(rows), step), axis=0)
        out.append(rows)
        if len(rows) == 1:
            return out
        step = FAN


def least(values: np.ndarray, counts: list[int], leaf: int) -> list[np.ndarray]:
    out, step = [], leaf
    for _ in counts:
        values = np.minimum.reduceat(values, np.arange(0, len(values), step))
        out.append(values)
        step = FAN
    return out


class Items:
    """Items searched together: dense weights over their own terms, and the maxima of their hierarchy."""

    def __init__(self, index: np.ndarray, bags: list[dict[int, int]], weights: np.ndarray):
        self.made_of = index, bags, weights
        known = sorted({t for b in bags for t in b})
        self.column = np.full(len(weights), -1, np.int64)
        self.column[known] = np.arange(len(known))
        self.width = len(known)
        most = max((sum(b.values()) for b in bags), default=0)
        self.kind = np.float64 if float(weights.max(initial=0)) * 1e6 * most < 2**53 else np.int64  # exact either way
        self.weights = np.zeros((len(bags), max(1, self.width)), self.kind)
        for i, b in enumerate(bags):
            for t, r in b.items():
                self.weights[i, self.column[t]] = r * weights[t]
        like = np.argsort(self.weights.argmax(1), kind="stable")  # items of one heaviest term next to each other
        self.weights, self.index = self.weights[like], index[like]
        self.levels = levels(self.weights, ITEM_LEAF)

    def __reduce__(self):
        return Items, self.made_of  # tasks are sent the terms, not the dense tables


class Best:
    """The best ``k`` (score, id) of each item so far; ``score`` and ``id`` of the weakest are what a document must reach."""

    def __init__(self, items: int, k: int, score: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.k = k
        self.score = np.ones(items, np.int64) if score is None else score.copy()
        self.ids = np.full(items, LAST) if ids is None else ids.copy()
        self.found = [tuple(np.empty(0, np.int64) for _ in range(3))]
        self.waiting = 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.found.append((item, score, ids))
        self.waiting += len(item)
        if self.waiting > SETTLE:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        item, score, ids = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        full = rank == self.k - 1
        self.score[item[full]], self.ids[item[full]] = score[full], ids[full]
        kept = rank < self.k
        self.found, self.waiting = [(item[kept], score[kept], ids[kept])], 0


class Documents:
    """A block of documents as postings over the columns of some items, sorted so that like documents share a leaf."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, ids: np.ndarray, items: Items):
        column = items.column[term]
        known = column >= 0
        doc, column, value = doc[known], column[known], value[known].astype(items.kind)
        weight = items.levels[-1][0][column] * value  # the most the term can give here
        order = np.lexsort((-weight, doc))
        first = order[np.unique(doc[order], return_index=True)[1]] if len(doc) else np.empty(0, np.int64)
        there = doc[first]
        by = np.lexsort((weight[first], column[first]))  # heaviest term, then what it gives
        place = np.full(len(ids), -1, np.int64)
        place[there[by]] = np.arange(len(by))
        self.ids = ids[there[by]]
        at = place[doc]
        order = np.argsort(at, kind="stable")
        self.at, self.column, self.value = at[order], column[order], value[order]
        self.n, self.width = len(self.ids), max(1, items.width)
        leaves = -(-self.n // DOC_LEAF)
        self.cuts = np.searchsorted(self.at, np.arange(leaves + 1) * DOC_LEAF)
        if not self.n:
            return
        top = np.zeros((leaves, self.width), items.kind)
        np.maximum.at(top, (self.at // DOC_LEAF, self.column), self.value)
        self.levels = levels(top, 1)
        self.least = least(self.ids, [len(x) for x in self.levels], DOC_LEAF)

    def leaf(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns that occur in a leaf and its documents' dense values there."""
        run = slice(self.cuts[n], self.cuts[n + 1])
        columns, back = np.unique(self.column[run], return_inverse=True)
        dense = np.zeros((min(DOC_LEAF, self.n - n * DOC_LEAF), len(columns)), self.value.dtype)
        dense[self.at[run] - n * DOC_LEAF, back] = self.value[run]
        return columns, dense


def search(docs: Documents, items: Items, best: Best) -> None:
    """Adds to ``best`` what the documents give to the items. Both hierarchies are opened a level at a time."""
    if not docs.n or not items.width:
        return
    weakest, ids = best.score[items.index], best.ids[items.index]

    def floors(level: int) -> tuple[np.ndarray, np.ndarray]:
        """Weakest kth score below each item node, and the latest id that still counts at that score."""
        low = least(weakest, items.levels[:level + 1], ITEM_LEAF)[level]
        node = np.arange(len(weakest)) // (ITEM_LEAF * FAN**level)
        late = np.full(len(low), -1, np.int64)
        same = weakest == low[node]
        np.maximum.at(late, node[same], ids[same])
        return low, late

    def opened(i: int, d: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (item node, document node) of two levels that can't go, with their bounds."""
        low, late = floors(i)
        keep, bound = [], []
        for node in np.unique(pairs[:, 0]):
            those = pairs[pairs[:, 0] == node, 1]
            top = docs.levels[d][those] @ items.levels[i][node]
            good = (top > low[node]) | ((top == low[node]) & (docs.least[d][those] <= late[node]))
            keep.append(np.stack([np.full(int(good.sum()), node), those[good]], 1))
            bound.append(top[good])
        return np.concatenate(keep), np.concatenate(bound)

    i, d = len(items.levels) - 1, len(docs.levels) - 1
    pairs, bound = opened(i, d, np.zeros((1, 2), np.int64))
    while (i or d) and len(pairs):
        for side in (0, 1):
            if (i, d)[side]:
                there = len((items, docs)[side].levels[(i, d)[side] - 1])
                kids = pairs[:, side, None] * FAN + np.arange(FAN)
                row, col = np.nonzero(kids < there)
                pairs = pairs[row]
                pairs[:, side] = kids[row, col]
        i, d = max(0, i - 1), max(0, d - 1)
        pairs, bound = opened(i, d, pairs)
    if not len(pairs):
        return
    strongest = np.zeros(len(docs.levels[0]))
    np.maximum.at(strongest, pairs[:, 1], bound.astype(np.float64))
    by = np.lexsort((pairs[:, 1], -strongest[pairs[:, 1]]))  # documents with the greatest bounds first
    pairs, bound = pairs[by], bound[by]
    starts = np.flatnonzero(np.r_[True, pairs[1:, 1] != pairs[:-1, 1]])
    for start, end in zip(starts, np.r_[starts[1:], len(pairs)]):
        n = int(pairs[start, 1])
        weakest, ids = best.score[items.index], best.ids[items.index]
        low, late = floors(0)
        node = pairs[start:end, 0]
        node = node[(bound[start:end] > low[node]) | ((bound[start:end] == low[node]) & (docs.least[0][n] <= late[node]))]
        if not len(node):
            continue
        who = (node[:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).reshape(-1)
        who = who[who < len(items.index)]
        columns, dense = docs.leaf(n)
        scores = (items.weights[np.ix_(who, columns)] @ dense.T).astype(np.int64)
        own = docs.ids[n * DOC_LEAF:n * DOC_LEAF + len(dense)]
        good = (scores > weakest[who, None]) | ((scores == weakest[who, None]) & (own <= ids[who, None]))
        row, col = np.nonzero(good & (scores > 0))
        if len(row):
            best.add(items.index[who[row]], scores[row, col], own[col])
    best.settle()


FORWARD = "doc_id long, n long, t array<int>, f array<int>, counts boolean"


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The terms of ``vocabulary`` in every document that has a term, and for each task a row of document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(len(vocabulary), np.int64)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]
        out = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "t", "f", "counts"])
        for b in slices(batches):
            rows: list[tuple] = []
            with no_collection():
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    bag = counted(text)
                    if bag:
                        t = np.array([vocabulary[w] for w in bag if w in vocabulary], np.int32)
                        frequency[t] += 1
                        rows.append((doc_id, bag.total(), t, np.array([c for w, c in bag.items() if w in vocabulary], np.int32)))
            if rows:
                yield out(*zip(*rows), [False] * len(rows))
        seen = np.flatnonzero(frequency)
        yield out([None], [None], [seen.astype(np.int32)], [frequency[seen].astype(np.int32)], [True])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FORWARD)


def searched(index: DataFrame, groups: list[Items], count: int, k: int, docs: int, total: int, first: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(item, doc_id, score, rank): the best ``k`` documents of each item, found task by task and ranked together."""
    width = max((g.width for g in groups), default=1)
    most = max(DOC_LEAF, min(DOCS, NUMBERS // max(1, width) * DOC_LEAF))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(count, k, *(first or (None, None)))
        held: list[tuple] = []

        def flush() -> None:
            ids, n, sizes, t, f = (np.concatenate(x) for x in zip(*held))
            held.clear()
            doc = np.repeat(np.arange(len(ids)), sizes)
            value = saturation(f.astype(np.int64), n[doc], docs, total)
            for g in groups:
                search(Documents(doc, t, value, ids, g), g, best)

        waiting = postings = 0
        for b in batches:
            at = 0
            sizes = np.diff(b.column("t").offsets.to_numpy()).astype(np.int64)
            while at < b.num_rows:
                room = np.searchsorted(np.cumsum(sizes[at:]), POSTINGS - postings, side="right")
                step = max(1, min(most - waiting, int(room), b.num_rows - at))
                part = b.slice(at, step)
                held.append((part.column("doc_id").fill_null(int(LAST)).to_numpy(), part.column("n").to_numpy(), sizes[at:at + step],
                             part.column("t").flatten().to_numpy(), part.column("f").flatten().to_numpy()))
                at, waiting, postings = at + step, waiting + step, postings + int(sizes[at:at + step].sum())
                if waiting >= most or postings >= POSTINGS or room == 0:
                    flush()
                    waiting = postings = 0
        if held:
            flush()
        best.settle()
        item, score, ids = best.found[0]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == LAST), pa.array(score)], names=["item", "doc_id", "score"])

    found = index.select("doc_id", "n", "t", "f").mapInArrow(run, "item long, doc_id long, score long")
    highest = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(highest)).where(F.col("rank") <= k)


def _ranked(docs: DataFrame, block: list[tuple], k: int, spark) -> DataFrame:
    """The ranking of a block of items, (item_id, text) pairs."""
    bags = [counted(text) for _, text in block]
    vocabulary = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
    written = store(forward(docs, vocabulary), "forward")
    index = written.where("NOT counts")
    n, total = index.agg(F.count("*"), F.sum("n")).first()
    sums = written.where("counts").select(F.explode(F.arrays_zip("t", "f")).alias("x")).groupBy("x.t").agg(F.sum("x.f").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in sums.toLocalIterator():  # one number for each term of the block
        weights[r["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    coded = [{vocabulary[w]: c for w, c in b.items()} for b in bags]
    wide = max(1, min(ITEMS, NUMBERS // max(1, len(vocabulary))))
    groups = [Items(np.arange(at, min(at + wide, len(block))), coded[at:at + wide], weights) for at in range(0, len(block), wide)]
    first = None
    if n and n > 2 * SAMPLE:
        some = index.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(-(-n // SAMPLE))) == 0).repartition(4)
        first = np.ones(len(block), np.int64), np.full(len(block), LAST)
        for r in searched(some, groups, len(block), k, n, total, None).where(F.col("rank") == k).toLocalIterator():
            first[0][r["item"]], first[1][r["item"]] = r["score"], LAST if r["doc_id"] is None else r["doc_id"]
    found = searched(index, groups, len(block), k, n, total, first)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 of each item.

    Items are taken in blocks of about ``ITEM_CHARS`` characters; a block's result is written before the next begins.
    """
    spark = docs.sparkSession
    items = store(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text <> ''").distinct(), "items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(chars) // ITEM_CHARS)
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()
        block = sorted(((r["item_id"], r["text"]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if not block:
            continue
        found = _ranked(docs, block, k, spark)
        found = store(found, "ranked") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
