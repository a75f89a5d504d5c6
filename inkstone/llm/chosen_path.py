"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Equal sets form a class with one representative. In each of TREES
independent trees a node picks one of the minwise tokens of its members (with chance 1 / threshold - 1 a second one
too), and members with equal tokens go to the same child. Nodes end at DEPTH, whatever their size: large ones are left to
the pivots and the pair comparison of links.py, because every further level would part more pairs at the threshold in all
trees. Of 100,000 simulated pairs at the threshold, all trees missed 10 at depth 3, 490 at 6 and 2,275 at 9. Links are
confirmed on full sets. In large nodes sets are compared by what they differ in from the node's pivot (``differing``).

Defined cases: a text with fewer words than a shingle is one shingle of all its words; without words the set is empty and
linked with nothing; rows of a null id are linked with nothing and kept, with a null class; rows that repeat an
id share its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import slices, store
from inkstone.llm.links import grouped

#: Nodes of more than SMALL members would branch on from START to DEPTH.
TREES, START, DEPTH, SMALL = 12, 3, 3, 12
TOKENS, BITS = 64, 64
#: 1-bit minwise sketches of a pair at similarity 0.8 differ in 6.4 of 64 bits, sd 2.4; at 22 fewer than one in a million is lost.
SKETCH_LIMIT = 22
#: Ids of a semi-join that are sent to every task: 8 bytes each.
BROADCAST_IDS = 2_000_000
#: Shingles of pivots that are sent to every task, 8 bytes each; more are joined by a shuffle.
BROADCAST_ITEMS = 4_000_000

_M1, _M2, _GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_KNOWN: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


_SEEDS = mix(np.arange(1, TOKENS + BITS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_KNOWN) > 400_000:
        _KNOWN.clear()
    get, put = _KNOWN.get, _KNOWN.__setitem__
    ids = []
    for w in words:
        h = get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            put(w, h)
        ids.append(h)
    h = np.array(ids, np.uint64)
    k = min(width, len(h))
    out = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix(out * _GOLD + h[i:len(h) - k + 1 + i])
    return np.unique(mix(out + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    """TOKENS + BITS minwise tokens of a set, in steps that keep memory small for long texts."""
    low = np.full(TOKENS + BITS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        x = s[at:at + 4096, None] * _SEEDS[None, :]
        x ^= x >> np.uint64(29)
        x *= _M1
        np.minimum(low, x.min(axis=0), out=low)
    return mix(low)


def branch(paths: np.ndarray, tokens: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of one level: every path goes on by the token it chooses, some by a second one."""
    n = np.arange(len(paths))
    first = mix(paths + _GOLD)
    second = mix(paths ^ _M2)
    both = (mix(first ^ second) % np.uint64(1000)) < np.uint64(round(1000 * (100 / threshold - 1)))
    rows = np.concatenate([n, n[both]])
    choice = np.concatenate([first, second[both]]) % np.uint64(TOKENS)
    own = np.concatenate([first, second[both]])
    return rows, mix(own * _GOLD + tokens[rows, choice.astype(np.int64)])


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, items): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, items array<long>")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch, tokens): set size, 128-bit key of the set, sketch bits and minwise tokens."""

    def one(text):
        s = shingle_set(text, width)
        if not len(s):
            return 0, 0, 0, 0, b""
        key = xxhash.xxh3_128_digest(s.tobytes())
        sig = signature(s)
        bits = np.packbits((sig[TOKENS:] & np.uint64(1)).astype(np.uint8)).tobytes()
        return (len(s), int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True),
                int.from_bytes(bits, "little", signed=True), (sig[:TOKENS] >> np.uint64(32)).astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = list(zip(*map(one, b.column("text").to_pylist())))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(got, kinds)]], names=["doc_id", "n", "k1", "k2", "sketch", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch long, tokens binary")


def _walk(rows: DataFrame, threshold: int, levels: int, trees: bool) -> DataFrame:
    """(bucket, id, n, sketch) after ``levels`` more levels; ``trees`` starts them at the roots of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "tokens"):
            tokens = np.stack([np.frombuffer(t, "<u4") for t in b.column("tokens").to_pylist()]).astype(np.uint64)
            if trees:
                at = np.repeat(np.arange(len(tokens)), TREES)
                paths = np.tile(mix(np.arange(1, TREES + 1, dtype=np.uint64) * _M2), len(tokens))
            else:
                at, paths = np.arange(len(tokens)), b.column("bucket").to_numpy().view(np.uint64)
            for _ in range(levels):
                pick, paths = branch(paths, tokens[at], threshold)
                at = at[pick]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), *[b.column(c).take(take) for c in ("id", "n", "sketch")]], names=["bucket", "id", "n", "sketch"])

    return rows.mapInArrow(run, "bucket long, id long, n long, sketch long")


def nodes(reps: DataFrame, threshold: int) -> DataFrame:
    """(bucket, id, n, sketch, far): members of all nodes with two or more members that branch no further.

    ``far`` falls with the number of members an id meets: the centre of a group of copies shares more minwise
    tokens with the others than they share among themselves, and is the best pivot.
    """
    rows = store(_walk(reps.select("id", "n", "sketch", "tokens"), threshold, START, True), "nodes")
    done: list[DataFrame] = []
    for depth in range(START, DEPTH + 1):
        size = rows.groupBy("bucket").agg(F.count("*").alias("m"))
        if depth == DEPTH:
            done.append(rows.join(size.where("m > 1"), "bucket"))
            break
        split = store(rows.join(size.where("m > 1"), "bucket"), f"sized-{depth}")
        done.append(split.where(f"m <= {SMALL}"))
        large = split.where(f"m > {SMALL}").drop("m")
        if large.isEmpty():
            break
        tokens = reps.select("id", "tokens")
        rows = store(_walk(large.join(tokens, "id"), threshold, 1, False), f"nodes-{depth + 1}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = store(out, "members")
    met = out.groupBy("id").agg((-F.sum("m")).alias("far"))
    return out.drop("m").join(met, "id").select("bucket", "id", "n", "sketch", "far")


def differing(at: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(id, j): pairs that hold every link between ids of one pivot and different groups ``g``, from (p, pg, id, g) and (doc_id, items).

    With x and y as their differences from the pivot's set, of sizes a and b, and n and m the sizes of the sets, a link means
    |x ^ y| <= r (n + m), r = (100 - threshold) / (100 + threshold), so x and y share (a + b - r (n + m)) / 2 items at least.
    Two ids that are linked to the pivot are in one group; of any other pair one, x, is not: a > r (n + p). Hence y shares
    more than half of b + r (p - m), and each shares all but (100 / threshold - 1) of its set's size. Both have one of
    their first items in common then, rare ones first (prefix filter); items of one set alone are left out before.
    """
    keep, sum_ = 100 - threshold, 100 + threshold
    ref = store(at.select("p").distinct().join(sets, F.col("p") == F.col("doc_id")).groupBy("p").agg(F.min("items").alias("r")), "pivot-sets")
    few = (ref.agg(F.sum(F.size("r"))).first()[0] or 0) <= BROADCAST_ITEMS
    d = F.concat(F.array_except("items", "r"), F.array_except("r", "items"))
    own = at.join(sets, F.col("id") == F.col("doc_id")).join(F.broadcast(ref) if few else ref, "p")
    own = store(own.select("p", "pg", "id", "g", F.xxhash64("items").alias("s"), F.size("items").alias("n"), F.size("r").alias("pn"), d.alias("d")), "differences")
    far = sum_ * F.size("d") > keep * (F.col("n") + F.col("pn"))
    to_pivot = own.where(~far & (F.col("g") != F.col("pg"))).select("id", F.col("p").alias("j"))
    items = own.select("p", "id", "s", F.explode("d").alias("item"))
    often = items.groupBy("p", "item").agg(F.count("*").alias("m")).where("m > 1")
    first = items.join(often, ["p", "item"]).groupBy("p", "id", "s").agg(F.array_sort(F.collect_list(F.struct("m", "item"))).alias("o"))
    sized = own.select("p", "id", "s", "g", "n", "pn", F.size("d").alias("a"), far.alias("far"))
    rows = store(sized.join(first, ["p", "id", "s"]).select("p", "pn", "far", "o.item", F.struct("id", "g", "n", "a", F.size("o").alias("k")).alias("x")), "prefixes")
    least = F.col("x.a") - F.floor(keep * F.col("x.n") / threshold)
    half = F.floor((sum_ * F.col("x.a") + keep * (F.col("pn") - F.col("x.n"))) / (2 * sum_)) + 1

    def prefix(needed: Column) -> Column:
        return F.explode(F.slice("item", 1, F.greatest(F.col("x.k") - needed + 1, F.lit(0)).cast("int"))).alias("item")

    probe = rows.where("far").select("p", "x", prefix(F.greatest(least, F.lit(1))))
    index = rows.select("p", F.col("x").alias("y"), prefix(F.greatest(least, half)))
    size = F.col("x.n") + F.col("y.n")
    apart = sum_ * (F.col("x.a") + F.col("y.a")) - keep * size
    pairs = probe.join(index, ["p", "item"]).where(
        (F.col("x.g") != F.col("y.g")) & (threshold * F.greatest("x.n", "y.n") <= 100 * F.least("x.n", "y.n"))
        & (sum_ * F.abs(F.col("x.a") - F.col("y.a")) <= keep * size) & (2 * sum_ * F.least("x.k", "y.k") >= apart))
    return pairs.select("x.id", F.col("y.id").alias("j")).unionByName(to_pivot)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``: linked when 100 * intersection >= threshold * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = store(signatures(docs, width), "signatures")
    named = sig.where("doc_id IS NOT NULL AND n > 0")
    classes = store(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.first("n").alias("n"),
                                                  F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "n", "sketch", "tokens")

    def near(a: str, b: str):
        return (F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))) <= SKETCH_LIMIT) & (
            100 * F.least(f"{a}.n", f"{b}.n") >= threshold * F.greatest(f"{a}.n", f"{b}.n"))

    def sharp(a: str, b: str):
        # two sets share at most what each of them shares with any other
        needed = threshold * (F.col(f"{a}.n") + F.col(f"{b}.n"))
        return near(a, b) & ((100 + threshold) * F.least(f"{a}.common", f"{b}.common") >= needed)

    def fetched(ids: DataFrame, name: str) -> DataFrame:
        ids = store(ids, f"{name}-ids")
        return store(sets_of(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi"), width).distinct(), name)

    def common(ids: DataFrame) -> DataFrame:
        """(id, common): how many items of a set occur in another set of these ids."""
        items = fetched(ids.withColumnRenamed("id", "doc_id"), "mixed-sets").select(F.col("doc_id").alias("id"), F.explode("items").alias("item"))
        lone = items.groupBy("item").agg(F.count("*").alias("m"), F.min("id").alias("id")).where("m = 1").groupBy("id").agg(F.count("*").alias("lone"))
        own = reps.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("sets"))  # an id of several rows has several sets
        kept = F.col("n") - F.when(F.col("sets") > 1, 0).otherwise(F.coalesce("lone", F.lit(0)))
        return own.join(ids, "id").join(lone, "id", "left").select("id", kept.alias("common"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = store(pairs, "candidates")
        sets = fetched(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "sets")
        left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
        both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(100 * common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()

    def beyond(large: DataFrame) -> DataFrame:
        pivot = large.groupBy("bucket").agg(F.min(F.struct("x.far", "x.id", "g")).alias("p"))
        at = store(large.join(pivot, "bucket").select(F.col("p.id").alias("p"), F.col("p.g").alias("pg"), "x.id", "g").distinct(), "pivoted")
        return differing(at, fetched(at.select(F.col("id").alias("doc_id")).distinct(), "pivoted-sets"), threshold)

    label = grouped(nodes(reps, threshold), near, sharp, verify, "far", common, beyond)
    shared = classes.where("m > 1").select("k1", "k2", "rep")
    rows = sig.join(shared, ["k1", "k2"], "left").select("doc_id", "n", F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("id"))
    out = rows.join(label, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
