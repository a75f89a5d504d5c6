"""Hard negatives by a cover tree over norm-augmented vectors.

One more component lifts every candidate to the sphere of the largest norm, so that an inner product follows from the
angle between a query and a candidate. The top level of the tree is a bounded set of centres; every row goes to its
nearest one, and the part around a centre is cut further where it holds too many rows. Inside a part each node takes
points of its own as the centres of its children, farthest first, until they cover it within half its radius: a centre
is its first child's centre, children lie within the covering radius, and the centres of a level are at least that
radius apart. Centre and radius bound the inner products of a node's rows. A search keeps nodes in a heap by their
greatest bound, with the queries that still need them: a query leaves a node whose bounds miss all its windows or
stay under its weakest kept score. Rows of a leaf are scored exactly, so results are exact whatever the geometry.

A stated set of anchors meets all rows, in blocks of anchors and parts of rows; each meeting is one bounded group.

Defined cases: a row with a null label, a null vector or a null or non-finite component takes no part; an empty vector
scores 0, missing last components count as 0; rows of an anchor's own ``id`` are never its partners; equal anchor rows
are one anchor, repeated partners take a rank each; a null ``id`` is no anchor and comes last among equal scores.
Scores are exact in 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import store

PART = 500_000  # numbers of a part's vectors: rows of a part are as many over the length of a vector
SAMPLE = 1_000_000  # numbers of the sample the top centres are chosen from
TOP = 1024  # centres of the top level at most
ANCHORS = 4096  # anchors of a block
FAN, LEAF = 16, 64  # children of a node, rows of a leaf
SETTLE = 100_000  # found pairs before they are ranked
SLACK = 1e-6  # of angles, for rounding
LAST = np.iinfo(np.int64).max  # stands for a null id


def candidates(rows: DataFrame, key: Column, label: Column, vector: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part; ``vector`` is an array of whole numbers."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return rows.where(label.isNotNull() & vector.isNotNull() & usable).select(
        key.cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long")).alias("vector"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, filled with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64) if len(column) else np.empty(0, np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Unit vectors of the augmented rows; ``top`` is the largest norm."""
    x = x.astype(np.float64)
    if not top:
        return np.hstack([x, np.ones((len(x), 1))])
    x = x / top
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))[:, None]])


def spread_out(u: np.ndarray, first: int, most: int, until: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centres from ``first`` until all rows are within ``until``; each row's centre and the cosine to it."""
    chosen, near = [first], u @ u[first]
    of = np.zeros(len(u), np.int64)
    while len(chosen) < most:
        far = int(near.argmin())
        if np.arccos(min(1.0, max(-1.0, near[far]))) <= until:
            break
        cosine = u @ u[far]
        closer = cosine > near
        of[closer], near[closer] = len(chosen), cosine[closer]
        if of[far] != len(chosen):  # equal but for rounding
            break
        chosen.append(far)
    of[chosen] = np.arange(len(chosen))  # a centre stays its own first point whatever the rounding
    return chosen, of, near


def radius(cosines: np.ndarray) -> float:
    angle = float(np.arccos(np.clip(cosines.min(), -1, 1)))
    return angle + SLACK if angle else 0.0


class Tree:
    """The tree of one part. ``order`` sorts its rows so that each node holds a run of them."""

    def __init__(self, x: np.ndarray, top: float):
        u = lifted(x, top)
        self.order, self.start, self.end, self.angle, self.children, centre = np.arange(len(u)), [], [], [], [], []

        def node(start: int, end: int, at: int, angle: float) -> int:
            for kept, value in ((self.start, start), (self.end, end), (self.angle, angle), (self.children, None), (centre, at)):
                kept.append(value)
            return len(centre) - 1

        todo = [node(0, len(u), 0, radius(u @ u[0]))] if len(u) else []
        while todo:
            n = todo.pop()
            start, end = self.start[n], self.end[n]
            if end - start <= LEAF or self.angle[n] <= 2 * SLACK:
                continue
            own = self.order[start:end].copy()
            chosen, of, near = spread_out(u[own], int(np.flatnonzero(own == centre[n])[0]), FAN, self.angle[n] / 2)
            if len(chosen) < 2:
                continue
            by = np.argsort(of, kind="stable")
            self.order[start:end] = own[by]
            cuts = np.searchsorted(of[by], np.arange(len(chosen) + 1))
            kids = [node(start + cuts[k], start + cuts[k + 1], int(own[c]), radius(near[of == k])) for k, c in enumerate(chosen)]
            self.children[n] = np.array(kids)
            todo += kids
        self.centres, self.angle, self.top = x[centre].astype(np.float64), np.array(self.angle), top
        self.x = x[self.order]
        self.real = self.x.astype(np.float64)


def bounds(products: np.ndarray, sizes: np.ndarray, angle: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of queries (rows, of the norms ``sizes``) with the rows of nodes (columns)."""
    reach = sizes[:, None] * top
    at = np.arccos(np.clip(np.divide(products, reach, out=np.zeros_like(products), where=reach > 0), -1, 1))
    room = SLACK * reach + 1e-6
    return reach * np.cos(np.minimum(np.pi, at + angle)) - room, reach * np.cos(np.maximum(0, at - angle)) + room


class Search:
    """The best ``k`` rows in each window of each query. ``low`` and ``high`` are (queries, windows); an empty window has low > high."""

    def __init__(self, q: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.q, self.label, self.own, self.low, self.high, self.k, self.same = q, label, own, low, high, k, same
        self.real = q.astype(np.float64)
        self.sizes = np.sqrt(np.einsum("ij,ij->i", self.real, self.real))
        self.least = low.copy()  # weakest score that still counts, by window
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [tuple(np.empty(0, np.int64) for _ in range(3))]
        self.waiting = 0

    def open(self, who: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Which queries still need a node of these bounds."""
        return ((upper[:, None] >= self.least[who]) & (lower[:, None] <= self.high[who]) & (self.least[who] <= self.high[who])).any(1)

    def settle(self) -> None:
        """Ranks what was found and raises the weakest scores."""
        group, score, ids = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        full = rank == self.k - 1
        self.least.reshape(-1)[group[full]] = score[full]
        kept = rank < self.k
        self.found, self.waiting = [(group[kept], score[kept], ids[kept])], 0

    def leaf(self, who: np.ndarray, x: np.ndarray, real: np.ndarray, label: np.ndarray, ids: np.ndarray, exact: bool) -> None:
        scores = (self.real[who] @ real.T).astype(np.int64) if exact else self.q[who] @ x.T
        fits = (self.label[who][:, None] == label) == self.same
        fits &= self.own[who][:, None] != ids
        fits &= (scores >= self.least[who].min(1)[:, None]) & (scores <= self.high[who].max(1)[:, None])
        row, col = np.nonzero(fits)
        if not len(row):
            return
        value, of = scores[row, col], who[row]
        for w in range(self.low.shape[1]):
            good = (value >= self.least[of, w]) & (value <= self.high[of, w])
            if good.any():
                self.found.append((of[good] * self.low.shape[1] + w, value[good], ids[col[good]]))
                self.waiting += int(good.sum())
        if self.waiting >= SETTLE:
            self.settle()

    def run(self, tree: Tree, label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, window, score, id) of the kept rows."""
        label, ids = label[tree.order], ids[tree.order]
        exact = float(np.abs(self.real).max(initial=0)) * float(np.abs(tree.real).max(initial=0)) * max(1, self.q.shape[1]) < 2**53

        def offer(nodes: np.ndarray, who: np.ndarray) -> None:
            lower, upper = bounds(self.real[who] @ tree.centres[nodes].T, self.sizes[who], tree.angle[nodes], tree.top)
            for j, n in enumerate(nodes.tolist()):
                keep = self.open(who, lower[:, j], upper[:, j])
                if keep.any():
                    heapq.heappush(heap, (-float(upper[keep, j].max()), n, who[keep], lower[keep, j], upper[keep, j]))

        heap: list[tuple] = []
        if len(tree.order) and len(self.q):
            offer(np.array([0]), np.arange(len(self.q)))
        seen = 0
        while heap:
            _, n, who, lower, upper = heapq.heappop(heap)
            who = who[self.open(who, lower, upper)]
            if not len(who):
                continue
            if tree.children[n] is not None:
                offer(tree.children[n], who)
                continue
            for at in range(tree.start[n], tree.end[n], 4 * LEAF):  # a leaf of equal rows can be long
                rows = slice(at, min(at + 4 * LEAF, tree.end[n]))
                self.leaf(who, tree.x[rows], tree.real[rows], label[rows], ids[rows], exact)
            seen += 1
            if seen & (seen - 1) == 0:  # early on, thresholds rise quickly
                self.settle()
        self.settle()
        group, score, found = self.found[0]
        return group // self.low.shape[1], group % self.low.shape[1], score, found


def _integers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(int(LAST)).to_numpy().astype(np.int64) if len(column) else np.empty(0, np.int64)


class Index:
    """All candidates in parts around the top centres, written once. What the driver holds is one vector and one radius per centre."""

    def __init__(self, rows: DataFrame):
        size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, width, norm2 = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(size)).first()
        self.n, self.width, self.top = int(n), max(1, int(width or 0)), float(norm2 or 0) ** 0.5
        self.rows_in_part = max(256, PART // self.width)
        wanted = min(TOP, -(-self.n // self.rows_in_part))
        most = max(TOP, SAMPLE // self.width) if self.width <= SAMPLE // TOP else max(1, SAMPLE // self.width)
        hashed = F.pmod(F.xxhash64("id", "vector"), F.lit(max(1, self.n // most)))
        sample = rows.where(hashed == 0).select("vector").limit(most).toArrow() if wanted > 1 else None
        x = matrix(sample.column(0), self.width) if sample is not None else np.zeros((1, self.width), np.int64)
        u = lifted(x, self.top)
        chosen = spread_out(u, 0, wanted)[0] if len(u) else [0]
        centres = u[chosen] if len(u) else lifted(np.zeros((1, self.width)), self.top)
        width_, top = self.width, self.top

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealt = 0  # equal rows part too
            for b in batches:
                cosine = lifted(matrix(b.column("vector"), width_), top) @ centres.T
                shard = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(shard)), shard], -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("label"), b.column("vector"), pa.array(shard), pa.array(angle), pa.array(np.arange(dealt, dealt + len(shard)))],
                    names=["id", "label", "vector", "shard", "angle", "deal"])
                dealt += len(shard)

        self.stored = store(rows.mapInArrow(assign, "id long, label long, vector array<long>, shard long, angle double, deal long"), "cover-rows")
        found = {r["shard"]: r for r in self.stored.groupBy("shard").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).toLocalIterator()}
        cuts = [-(-found[s]["n"] // self.rows_in_part) if s in found else 0 for s in range(len(centres))]
        self.centres = centres[:, :-1] * (self.top or 1)
        self.angle = np.array([found[s]["angle"] + SLACK if s in found else 0.0 for s in range(len(centres))])
        self.first = np.concatenate([[0], np.cumsum(cuts)])
        self.parts = int(self.first[-1])

    def rows(self) -> DataFrame:
        """(part, id, label, vector)."""
        first, cuts = (F.array(*[F.lit(int(v)) for v in x]) for x in (self.first[:-1], np.diff(self.first)))
        at = lambda x: F.element_at(x, F.col("shard").cast("int") + 1)
        return self.stored.select((at(first) + F.col("deal") % at(cuts)).cast("long").alias("part"), "id", "label", "vector")

    def best(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, anchor_key, low, high, id, score): the best ``k`` rows of each window among all rows.

        ``anchors``: anchor_id, anchor_key, label, vector and the windows ``low`` and ``high``, arrays of equal length.
        """
        centres, angle, top, width, first = self.centres, self.angle, self.top, self.width, self.first

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """An anchor goes to the parts around the centres whose bounds meet one of its windows."""
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    q = matrix(part.column("vector"), width).astype(np.float64)
                    lower, upper = bounds(q @ centres.T, np.sqrt(np.einsum("ij,ij->i", q, q)), angle, top)
                    meets = np.zeros(lower.shape, bool)
                    for i, (lo, hi) in enumerate(zip(part.column("low").to_pylist(), part.column("high").to_pylist())):
                        for x, y in zip(lo, hi):
                            meets[i] |= (upper[i] >= x) & (lower[i] <= y)
                    row, shard = np.nonzero(meets)
                    cuts = first[shard + 1] - first[shard]
                    row, start = np.repeat(row, cuts), np.repeat(first[shard], cuts)
                    to = start + np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                    got = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), *got.columns], names=["part", *got.schema.names])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            n = right.num_rows
            windows = max((len(x) for x in right.column("low").to_pylist()), default=1) or 1
            low, high = np.zeros((n, windows), np.int64), np.full((n, windows), -1, np.int64)
            for out, name in ((low, "low"), (high, "high")):
                for i, x in enumerate(right.column(name).to_pylist()):
                    out[i, :len(x)] = x
            search = Search(matrix(right.column("vector"), width), _integers(right.column("label")), _integers(right.column("anchor_id")), low, high, k, same)
            rows = matrix(left.column("vector"), width)
            who, w, score, ids = search.run(Tree(rows, top), _integers(left.column("label")), _integers(left.column("id")))
            return pa.table({
                "anchor_id": right.column("anchor_id").combine_chunks().take(pa.array(who)), "anchor_key": right.column("anchor_key").combine_chunks().take(pa.array(who)),
                "low": pa.array(low[who, w]), "high": pa.array(high[who, w]), "id": pa.array(ids, mask=ids == LAST), "score": pa.array(score)})

        n = anchors.count()
        blocks = max(1, -(-n // ANCHORS))
        kinds = "anchor_id long, anchor_key long, label long, vector array<long>, low array<long>, high array<long>"
        sent = anchors.select(*(c.split()[0] for c in kinds.split(", "))).mapInArrow(route, f"part long, {kinds}").withColumn(
            "block", F.pmod("anchor_key", F.lit(blocks)))
        rows = self.rows().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = rows.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(
            meet, "anchor_id long, anchor_key long, low long, high long, id long, score long")
        best_first = Window.partitionBy("anchor_id", "anchor_key", "low", "high").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``rows`` as ``candidates`` gives them. A negative's score is between ``low`` and ``high`` percent of the positive's;
    for a positive score under 0 no score is.
    """
    index = Index(rows)
    key = F.xxhash64("id", "label", "vector")
    anchors = store(index.stored.where(is_anchor & F.col("id").isNotNull()).select(
        F.col("id").alias("anchor_id"), key.alias("anchor_key"), "label", "vector").dropDuplicates(["anchor_id", "anchor_key"]), "anchors")
    if not index.parts:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = [F.array(F.lit(v).cast("long")) for v in (-(1 << 62), 1 << 62)]
    near = store(index.best(anchors.withColumns({"low": whole[0], "high": whole[1]}), positives, True).where("score >= 0").select(
        "anchor_id", "anchor_key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high")).where("low <= high"), "positives")
    windows = near.groupBy("anchor_id", "anchor_key").agg(F.collect_set(F.struct("low", "high")).alias("w")).select(
        "anchor_id", "anchor_key", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    negative = index.best(store(anchors.join(windows, ["anchor_id", "anchor_key"]), "windows"), negatives, False)
    return near.join(negative, ["anchor_id", "anchor_key", "low", "high"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
