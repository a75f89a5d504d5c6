"""Graph operators on edge tables (source, target, weight); loops cut lineage in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import cut_lineage, written


def build(records: DataFrame, chunk: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities (title, type, frequency) and edges (source, target, weight, n_chunks) from parsed records."""
    ents = records.where("kind = 'entity'").groupBy(F.col("a").alias("title"), F.col("b").alias("type")).agg(
        F.count_distinct(*[F.col(c) for c in chunk]).alias("frequency"))
    edges = records.where("kind = 'relationship'").groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(
        F.sum("strength").alias("weight"), F.count_distinct(*[F.col(c) for c in chunk]).alias("n_chunks"))
    return ents, edges


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    """(v, nbr, cols..) rows of an undirected edge table in both directions."""
    return edges.select(F.inline(F.array(F.struct(F.col("source").alias("v"), F.col("target").alias("nbr"), *cols),
                                         F.struct(F.col("target").alias("v"), F.col("source").alias("nbr"), *cols))))


def degrees(edges: DataFrame) -> DataFrame:
    """(title, degree): distinct neighbours; duplicates are removed before counting, hubs by partial sums."""
    return both_ways(edges).distinct().groupBy(F.col("v").alias("title")).agg(F.count("*").alias("degree"))


def combined_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return edges.join(d.select(F.col("title").alias("source"), F.col("degree").alias("ds")), "source").join(
        d.select(F.col("title").alias("target"), F.col("degree").alias("dt")), "target").select(
        "source", "target", "weight", (F.col("ds") + F.col("dt")).alias("combined_degree"))


def components(edges: DataFrame) -> DataFrame:
    """(title, component): smallest title of each connected component.

    Every round a vertex links to the smallest label around it and all link chains are flattened
    by pointer doubling, so long paths collapse at once. Edges inside a settled part
    are rewritten to labels and removed, so the edge table shrinks each round.
    """
    live = cut_lineage(edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    label = cut_lineage(live.select(F.explode(F.array("a", "b")).alias("title")).distinct().withColumn("component", F.col("title")))
    while not live.isEmpty():
        pairs = live.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("m")), F.struct(F.col("b").alias("v"), F.col("a").alias("m")))))
        link = pairs.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("m"))
        # pointer doubling: a chain of n links is flat after log2(n) jumps
        while True:
            up = link.select(F.col("v").alias("m"), F.col("m").alias("root"))
            jumped = cut_lineage(link.join(up, "m").select("v", "m", "root"))
            link = jumped.select("v", F.col("root").alias("m"))
            if jumped.where("m <> root").isEmpty():
                break
        link = jumped.select("v", "root")
        label = cut_lineage(label.join(link.select(F.col("v").alias("component"), "root"), "component", "left").select(
            "title", F.coalesce("root", "component").alias("component")))
        step = live.join(link.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(link.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
        live = cut_lineage(step.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return label


def largest_component(edges: DataFrame) -> DataFrame:
    """(title, component, kept): kept is the largest component, smallest label on ties."""
    c = components(edges)
    size = c.groupBy("component").agg(F.count("*").alias("n"))
    best = size.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("component").alias("c"))).alias("b")).select(F.col("b.c").alias("best"))
    return c.join(F.broadcast(best)).select("title", "component", (F.col("component") == F.col("best")).alias("kept"))  # one row


EPS = 1e-12  # of modularity: less is rounding


NODE = ["part", "v", "label", "k", "own", "m2"]  # degree, twice the weight of own loops, the part's sum of degrees


SMALL = 1_000_000  # vertices up to which their labels are sent to every task instead of being joined by shuffle


def moves(und: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """``nodes`` (part, v, label, k, own, m2) with ``t``, the degrees of its community, ``stay``, the weight of its edges inside,
    and ``new`` and ``gain``: the neighbouring community it gains most modularity by joining, null if it gains by none.

    Neighbour weights are partial sums, so a hub is no single task. Smaller labels win ties. ``few`` says that there are
    no more than ``SMALL`` vertices.
    """
    send = F.broadcast if few else lambda df: df
    n = nodes.join(send(nodes.groupBy("part", "label").agg(F.sum("k").alias("t"))), ["part", "label"])
    link = und.join(send(n.select("part", F.col("v").alias("nbr"), F.col("label").alias("c"), F.col("t").alias("tc"))), ["part", "nbr"])
    link = link.groupBy("part", "v", "c").agg(F.sum("weight").alias("w"), F.any_value("tc").alias("tc"))
    there = F.col("c") == F.col("label")
    other = F.when(~there, F.struct((F.col("k") * F.col("tc") / F.col("m2") - F.col("w")).alias("s"), F.col("c").alias("c")))
    per = n.join(link, ["part", "v"], "left").groupBy("part", "v").agg(
        *[F.any_value(x).alias(x) for x in (*NODE[2:], "t")], F.coalesce(F.max(F.when(there, F.col("w"))), F.lit(0.0)).alias("stay"), F.min(other).alias("b"))
    gain = 2 * (F.col("k") * (F.col("t") - F.col("k")) / F.col("m2") - F.col("stay") - F.col("b.s")) / F.col("m2")
    return per.withColumn("gain", gain).select(*NODE, "t", "stay", F.when(F.col("gain") > EPS, F.col("b.c")).alias("new"), "gain")


def quality(view: DataFrame) -> DataFrame:
    """(part, q, open): modularity of each part, and whether any of its vertices can gain, from what ``moves`` gives."""
    m2 = F.max("m2")
    return view.groupBy("part").agg(((F.sum("stay") + F.sum("own")) / m2 - F.sum(F.col("k") * F.col("t")) / (m2 * m2)).alias("q"), F.bool_or(F.col("new").isNotNull()).alias("open"))


def _settle(und: DataFrame, nodes: DataFrame) -> tuple[DataFrame, bool]:
    """Moves vertices until no move gains; the nodes with their labels, and whether any moved.

    In a round those moves are made that are the best one of both communities they touch: no two of them have a
    community in common, so their gains add up. A share of the others, by hash, moves with them; a part whose modularity
    did not rise takes its round back and lowers the share, at last to none. So modularity rises and the loop ends.
    """
    moved, turn = False, 0
    few = nodes.count() <= SMALL
    cur = written(moves(und, nodes, few))
    state = written(quality(cur).select("part", "q", F.lit(0.5).alias("share"), (~F.col("open")).alias("ended"), F.lit(False).alias("up")))
    while True:
        over = state.agg(F.bool_and("ended")).first()[0]
        if over is None or over:
            return cur.select(*NODE), moved
        turn += 1
        cand = cur.where("new IS NOT NULL").join(state.where("NOT ended").select("part", "share"), "part")
        ends = cand.select("part", "v", "gain", F.explode(F.array("label", "new")).alias("c"))
        best = ends.groupBy("part", "c").agg(F.min(F.struct((-F.col("gain")).alias("g"), "v")).alias("b")).select("part", F.col("b.v").alias("v"))
        free = best.groupBy("part", "v").agg((F.count("*") == 2).alias("free"))
        luck = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        chosen = cand.join(free, ["part", "v"], "left").where(F.coalesce("free", F.lit(False)) | (luck < F.col("share"))).select("part", "v", F.col("new").alias("to"))
        trial = written(moves(und, cur.select(*NODE).join(chosen, ["part", "v"], "left").withColumn("label", F.coalesce("to", "label")).select(*NODE), few))
        after = quality(trial).withColumnRenamed("q", "q1")
        up = ~F.col("ended") & (F.col("q1") > F.col("q") + EPS)
        state = written(state.drop("up").join(after, "part").select(
            "part", F.when(up, F.col("q1")).otherwise(F.col("q")).alias("q"),
            F.when(up, F.least(F.lit(0.5), F.col("share") * 2)).when(F.col("share") < 0.05, 0.0).otherwise(F.col("share") / 4).alias("share"),
            (F.col("ended") | (up & ~F.col("open")) | (~up & (F.col("share") == 0.0))).alias("ended"), up.alias("up"), (up | F.col("ended")).alias("taken")))
        some, every = state.agg(F.bool_or("up"), F.bool_and("taken")).first()
        moved = moved or some
        if every:
            cur = trial
        elif some:
            kept = state.where("up").select("part")
            cur = written(trial.join(kept, "part", "left_semi").unionByName(cur.join(kept, "part", "left_anti")))
        state = state.drop("taken")


IN_TASK = 1_000_000  # edges of a part up to which one task divides it, in about 100 bytes an edge


def _lucky(hashes: np.ndarray, turn: int) -> np.ndarray:
    """``pmod(xxhash64(v, turn), 1 << 20) / (1 << 20)`` from ``xxhash64(v)``: Spark seeds the hash of a column with that of the one before."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = hashes.view(np.uint64) + five + np.uint64(4)
        h = h ^ (np.uint64(turn) * one)
        h = (h << np.uint64(23) | h >> np.uint64(41)) * two + three
        h = (h ^ h >> np.uint64(33)) * two
        h = (h ^ h >> np.uint64(29)) * three
        h = h ^ h >> np.uint64(32)
    return (h & np.uint64((1 << 20) - 1)).astype(np.float64) / (1 << 20)


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and the sum of the weights of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0)


class _Part:
    """``moves``, ``quality`` and ``_settle`` for the graph of one part in one task: vertices are numbers in the order of their titles."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, k: np.ndarray, own: np.ndarray, hashes: np.ndarray, m2: float):
        self.src, self.dst, self.weight, self.k, self.own, self.hashes, self.m2, self.n = src, dst, weight, k, own, hashes, m2, len(k)

    def moves(self, label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(modularity, new community or -1, gain) for these labels."""
        k, m2, n = self.k, self.m2, self.n
        t = np.bincount(label, k, n)
        key, w = _sums(self.src * n + label[self.dst], self.weight)
        v, c = key // n, key % n
        there = c == label[v]
        stay = np.zeros(n)
        stay[v[there]] = w[there]
        v, c, s = v[~there], c[~there], k[v[~there]] * t[c[~there]] / m2 - w[~there]
        new, gain = np.full(n, -1, np.int64), np.full(n, -np.inf)
        if len(v):
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            least = np.repeat(np.minimum.reduceat(s, first), np.diff(np.r_[first, len(v)]))
            at = np.flatnonzero(s == least)  # the first of equals has the smallest label
            at = at[np.r_[True, v[at][1:] != v[at][:-1]]]
            u = v[at]
            gain[u] = 2 * (k[u] * (t[label[u]] - k[u]) / m2 - stay[u] - s[at]) / m2
            new[u] = np.where(gain[u] > EPS, c[at], -1)
        return (stay.sum() + self.own.sum()) / m2 - (k * t[label]).sum() / (m2 * m2), new, gain

    def settle(self, label: np.ndarray) -> tuple[np.ndarray, bool]:
        q, new, gain = self.moves(label)
        share, turn, moved, ended = 0.5, 0, False, not (new >= 0).any()
        while not ended:
            turn += 1
            cand = np.flatnonzero(new >= 0)
            ends, who = np.r_[label[cand], new[cand]], np.r_[cand, cand]
            order = np.lexsort((who, -gain[who], ends))
            best = who[order][np.r_[True, ends[order][1:] != ends[order][:-1]]]
            free = np.bincount(best, minlength=self.n)[cand] == 2
            go = cand[free | (_lucky(self.hashes[cand], turn) < share)]
            trial = label.copy()
            trial[go] = new[go]
            q1, new1, gain1 = self.moves(trial)
            if q1 > q + EPS:
                label, q, new, gain, moved = trial, q1, new1, gain1, True
                share, ended = min(0.5, share * 2), not (new >= 0).any()
            else:
                ended, share = share == 0.0, 0.0 if share < 0.05 else share / 4
        return label, moved


def _divided(edges: pa.Table) -> pa.Table:
    """(part, v, label) of the edges (part, a, b, weight, ha, hb) of one part; the steps of ``communities`` in one task."""
    ends = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks]).combine_chunks().dictionary_encode()
    found = ends.dictionary.to_pylist()
    order = sorted(range(len(found)), key=found.__getitem__)
    titles, n = [found[i] for i in order], len(found)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    at = rank[ends.indices.to_numpy()]
    hashes = np.empty(n, np.int64)
    hashes[at] = np.r_[edges.column("ha").to_numpy(), edges.column("hb").to_numpy()]
    a, b = np.split(at, 2)
    src, dst, weight = np.r_[a, b], np.r_[b, a], np.tile(edges.column("weight").to_numpy().astype(np.float64), 2)
    k, m2 = np.bincount(src, weight, n), weight.sum()
    flat = _Part(src, dst, weight, k, np.zeros(n), hashes, m2)
    label, moved = np.arange(n), True
    while moved:
        label, _ = flat.settle(label)
        key, between = _sums(label[src] * n + label[dst], weight)
        s, d = key // n, key % n
        own = np.zeros(n)
        own[s[s == d]] = between[s == d]
        # numbers that are no community have no edges and no degree
        up, moved = _Part(s[s != d], d[s != d], between[s != d], np.bincount(label, k, n), own, hashes, m2).settle(np.arange(n))
        label = up[label] if moved else label
    part = edges.column("part")[0].as_py()
    return pa.table([pa.array([part] * n, pa.string()), pa.array(titles, pa.string()), pa.array([titles[x] for x in label], pa.string())], names=["part", "v", "label"])


def communities(edges: DataFrame) -> DataFrame:
    """(part, v, label): communities of each part's graph at which neither a vertex nor a whole community gains by moving.

    ``edges`` (part, source, target, weight). Vertices move to a neighbour's community while that raises modularity;
    then communities are contracted to vertices that move in the same way; both repeat until nothing moves.
    A part of up to ``IN_TASK`` edges is divided by one task, larger ones by rounds of joins; both make the same moves.
    """
    e = written(edges.where("source <> target").groupBy("part", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight")))
    # weights that are no numbers or have no sum are left to the joins
    sizes = e.groupBy("part").agg((F.count("*") <= IN_TASK) & (F.sum("weight") > 0) & (F.max(F.abs("weight")) < float("inf")) & F.bool_and(F.col("weight").isNotNull()))
    sizes = written(sizes.toDF("part", "small"))
    small = e.join(sizes.where("small"), "part").select(F.col("part").cast("string").alias("part"), "a", "b", "weight", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"))
    done = small.groupBy("part").applyInArrow(_divided, "part string, v string, label string")
    large = sizes.where("NOT coalesce(small, false)")
    return done if large.isEmpty() else done.unionByName(_joined(e.join(large, "part", "left_semi")))


def _joined(e: DataFrame) -> DataFrame:
    """``communities`` of summed edges (part, a, b, weight) by rounds of joins."""
    und = written(e.select("part", F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("nbr"), "weight"), F.struct(F.col("b").alias("v"), F.col("a").alias("nbr"), "weight")))))
    m2 = und.groupBy("part").agg(F.sum("weight").alias("m2"))
    nodes = written(und.groupBy("part", "v").agg(F.sum("weight").alias("k")).join(m2, "part").select("part", "v", F.col("v").alias("label"), "k", F.lit(0.0).alias("own"), "m2"))
    while True:
        nodes, _ = _settle(und, nodes)
        ends = und.join(nodes.select("part", "v", "label"), ["part", "v"]).join(nodes.select("part", F.col("v").alias("nbr"), F.col("label").alias("c")), ["part", "nbr"])
        between = written(ends.groupBy("part", "label", "c").agg(F.sum("weight").alias("weight")))
        inner = between.where("label = c").select("part", F.col("label").alias("v"), F.col("weight").alias("own"))
        above = nodes.groupBy("part", F.col("label").alias("v")).agg(F.sum("k").alias("k"), F.max("m2").alias("m2")).join(inner, ["part", "v"], "left")
        above = written(above.select("part", "v", F.col("v").alias("label"), "k", F.coalesce("own", F.lit(0.0)).alias("own"), "m2"))
        above, moved = _settle(between.where("label <> c").select("part", F.col("label").alias("v"), F.col("c").alias("nbr"), "weight"), above)
        if not moved:
            return nodes.select("part", "v", "label")
        up = above.select("part", F.col("v").alias("label"), F.col("label").alias("up"))
        nodes = written(nodes.join(up, ["part", "label"]).withColumn("label", F.col("up")).select(*NODE))


def community_labels(edges: DataFrame, max_size: int) -> DataFrame:
    """(title, level, label): communities by modularity; those above ``max_size`` are divided on their inner edges.

    All of a level's oversized communities are divided together, until every one fits or none of them can be divided:
    a part whose best division is itself stays. Labels of a level extend the parent's label.
    """
    level, out = 0, None
    cur = communities(edges.select(F.lit("").alias("part"), "source", "target", "weight")).select(F.col("v").alias("title"), "label")
    while True:
        cur = written(cur)
        rows = cur.withColumn("level", F.lit(level)).select("title", "level", "label")
        out = rows if out is None else out.unionByName(rows)
        big = cur.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > max_size).select("label")
        inside = written(cur.join(big, "label"))
        inner = edges.join(inside.select(F.col("title").alias("source"), F.col("label").alias("part")), "source").join(
            inside.select(F.col("title").alias("target"), F.col("label").alias("q")), "target").where("part = q AND source <> target").select("part", "source", "target", "weight")
        inner = written(inner)
        if inner.isEmpty():
            return out
        sub = written(communities(inner))
        several = sub.groupBy("part").agg(F.count_distinct("label").alias("n")).where("n > 1").select("part")
        sub = sub.join(several, "part", "left_semi")
        if sub.isEmpty():
            return out
        level += 1
        cur = sub.select(F.col("v").alias("title"), F.concat("part", F.lit("/"), "label").alias("label"))


def hierarchy(communities: DataFrame) -> DataFrame:
    """Every community with its parent's title and the number and first and last title of its children."""
    kids = communities.groupBy(F.col("parent").alias("community")).agg(
        F.count("*").alias("n_children"), F.min("title").alias("first_child"), F.max("title").alias("last_child"))
    up = communities.select(F.col("community").alias("parent"), F.col("title").alias("parent_title"))
    return communities.join(up, "parent", "left").join(kids, "community", "left").select(
        "community", "level", "title", "parent_title", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child", "last_child")
