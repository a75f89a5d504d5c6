"""Mixing sources to target weights by Pareto order sampling.

A source gets a share of the budget by its weight, at most ``most`` times its own words; what is over goes to the
other sources by weight until none is above. Inside a source a document's expected copies fall with the length of its
text (half for sixteen times the words, ``lean``), which steadies the sum, and are at most ``most`` too. The whole part
of them is allotted for certain. The rest is an unequal-probability sample: documents are ranked by their random odds
over their inclusion odds, and the sample's size is fixed in words, the rest of the source's target. The long documents
of a source are a sample of their own, of the words they may expect; the level of the short ones is then set by what
is left, their ranks run as far as it allows, once more among all documents that still fit, and at last the one
document that comes nearest is taken if that is nearer than none.

Runs are found without a source in one task: ranks are cut into buckets, words summed by bucket, and rows compared
only in the bucket where a run ends. Random numbers come from a digest of id and text, so reruns agree.

Defined cases: a null text has no words; documents without words are taken 0 times; a null source is a source of its
own, last in order; repeated rows are documents of their own, equal ones in any order; of an empty table nothing is
taken. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import BLANKS, store
from inkstone.operators.ranking import global_rank

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
BUCKET_ROWS = 4096  # documents of a bucket of ranks, about
LONG = 64  # a document longer than its source's target over this is ranked among the long ones
SOURCES = 100_000  # rows of the table of sources up to which it is broadcast
SEED = "mix-1"


def words(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, key, size, u): a row per document with its words and its random number in (0, 1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.col("source").cast("string")
    digest = F.md5(F.concat(F.lit(SEED), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), name.alias("source"),
        F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name)).alias("key"),  # never null, null last
        F.regexp_count(text, F.lit(f"[^{BLANKS}]+")).cast("long").alias("size"),
        ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)).alias("u"))


#: Relative copies by length: 1 up to 15 words, half up to 255, and so on; exact in binary.
LEAN = "1D / shiftleft(1L, CAST((length(bin(size)) - 1) div 4 AS INT))"


def fill(parts: DataFrame, groups: list[str]) -> DataFrame:
    """``parts`` (groups, weight, cap, total) with ``level``: amounts ``least(weight * level, cap)`` of a group add up to its total.

    In each round the parts above their caps are cut to them and the level of the others rises. One row per group and round meets.
    """
    parts = store(parts.withColumn("capped", F.lit(False)), "fill")
    while True:
        rest = parts.groupBy(*groups).agg(
            F.max("total").alias("_t"), F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).alias("_c"),
            F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).alias("_w"))
        level = rest.select(*groups, F.when(F.col("_w") > 0, (F.col("_t") - F.col("_c")) / F.col("_w")).otherwise(0.0).alias("level"))
        found = parts.join(level, groups) if groups else parts.withColumn("level", F.lit(level.first()[0]))
        found = store(found.withColumn("over", ~F.col("capped") & (F.col("weight") * F.col("level") > F.col("cap"))), "fill")
        if found.where("over").isEmpty():
            return found.drop("over")
        parts = found.withColumn("capped", F.col("capped") | F.col("over")).drop("over", "level")


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SOURCES else table


def targets(sizes: DataFrame, weights: Sequence[int], budget: float, most: int) -> DataFrame:
    """(key, source_size, target) of every source."""
    source = store(sizes.groupBy("key").agg(F.sum("size").alias("source_size")), "sources")
    total = source.agg(F.sum("source_size")).first()[0] or 0
    ranked = global_rank(source, ["key"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    parts = ranked.withColumns({"weight": weight, "cap": most * F.col("source_size").cast("double"), "total": F.lit(budget * total)})
    return fill(parts, []).select(
        "key", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def runs(rows: DataFrame, rest: DataFrame, buckets: int, sources: int) -> DataFrame:
    """Row numbers of the longest run of ranks of each source whose words are within the source's ``rest``."""
    rows = rows.withColumn("bucket", F.floor(F.col("v") * buckets))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("w"))
    in_order = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("through", F.sum("w").over(in_order)).join(small(rest, sources), "key").where("through > rest").groupBy("key").agg(
        F.min(F.struct("bucket", (F.col("through") - F.col("w")).alias("before"), "rest")).alias("end"))
    at = rows.join(small(ends, sources), "key", "left")
    whole = at.where("end IS NULL OR bucket < end.bucket").select("row")
    running = F.sum("size").over(Window.partitionBy("key").orderBy("v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    part = at.where("bucket = end.bucket").withColumn("through", F.col("end.before") + running).where("through <= end.rest").select("row")
    return whole.unionByName(part)


def nearest(rows: DataFrame, rest: DataFrame, sources: int) -> DataFrame:
    """The row number of the one document of each source that comes nearest to its ``rest``, if nearer than none or if one ``must``."""
    return rows.join(small(rest, sources), "key").where("must OR abs(rest - size) < rest").groupBy("key").agg(
        F.min(F.struct(F.expr("abs(rest - size)").alias("off"), "v", "row")).alias("x")).select(F.col("x.row").alias("row"))


def words_of(rows: DataFrame, got: DataFrame) -> DataFrame:
    return rows.join(got, "row").groupBy("key").agg(F.sum("size").alias("used"))


def odds(rows: DataFrame, totals: DataFrame, most: int, part: str) -> DataFrame:
    """The documents of ``part`` with their certain copies ``whole``, inclusion probability ``p`` and rank value ``v``.

    Expected copies of the documents that ``totals`` is for are ``lean`` times a level that makes the words of each
    source add up to its total: of all documents for the long ones, which are judged against all, else of ``part``.
    ``v`` orders like the random odds over the inclusion odds and lies in (0, 1).
    """
    basis = rows if part == "long" else rows.where(part)
    lengths = basis.groupBy("key", "lean").agg(F.sum("size").alias("words")).join(totals, "key")
    level = fill(lengths.select("key", "lean", (F.col("lean") * F.col("words")).alias("weight"), (most * F.col("words").cast("double")).alias("cap"), "total"), ["key"])
    copies = store(level.select("key", "lean", F.when(F.col("capped"), float(most)).otherwise(F.col("lean") * F.col("level")).alias("e")), "copies")
    x, y = "u * (1 - p)", "(1 - u) * p"
    return store(rows.where(part).join(small(copies, copies.count()), ["key", "lean"])
                 .select("row", "doc_id", "key", "size", "u", "long", F.floor("e").alias("whole"), (F.col("e") - F.floor("e")).alias("p"))
                 .withColumn("v", F.when(F.col("p") > 0, F.expr(f"{x} / ({x} + {y})"))), "drawn")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) of every document; ``taken`` is ``copies`` times ``size``."""
    sizes = store(words(docs), "sizes")
    count = sizes.count()
    goal = store(targets(sizes, weights, budget, most), "targets")
    sources = goal.count()

    buckets = max(16, -(-count // BUCKET_ROWS))
    rows = sizes.where("size > 0").withColumn("lean", F.expr(LEAN)).join(small(goal, sources), "key").withColumn("long", F.col("size") * LONG > F.col("target"))
    rows = store(rows.select("row", "doc_id", "key", "lean", "size", "u", "long", "target"), "rows")
    drawn = odds(rows, rows.select("key", F.col("target").alias("total")).distinct(), most, "long")

    # long documents first: as many words as they may expect, or as the short ones can't give
    per = rows.groupBy("key").agg(F.max("target").alias("target"), F.sum(F.when(~F.col("long"), F.col("size")).otherwise(0)).alias("short"))
    given = drawn.groupBy("key").agg(F.sum(F.expr("whole * size")).alias("given"), F.sum(F.expr("p * size")).alias("share"))
    per = store(per.join(given, "key", "left").fillna(0, ["given", "share"]).withColumn("need", F.expr(f"target - given - {most} * short")).withColumn("want", F.expr("greatest(share, need)")), "per")
    open_long = drawn.where("p > 0")
    first = store(runs(open_long, per.select("key", F.col("want").alias("rest")), buckets, sources), "first")
    after = per.join(words_of(drawn, first), "key", "left").select("key", F.expr("want - coalesce(used, 0)").alias("rest"), F.expr("need - coalesce(used, 0) > 0").alias("must"))
    picked = [store(first.unionByName(nearest(open_long.join(first, "row", "left_anti"), after, sources)), "picked")]

    # then the level of the short ones is set anew by what is left of the target
    rest = store(per.join(words_of(drawn, picked[0]), "key", "left").withColumn("rest", F.expr("target - given - coalesce(used, 0)")), "rest")
    short = odds(rows, rest.select("key", F.expr(f"least(greatest(rest, 0D), {most}D * short)").alias("total")), most, "NOT long")
    given = short.groupBy("key").agg(F.sum(F.expr("whole * size")).alias("more"))
    rest = store(rest.join(given, "key", "left").select("key", F.expr("rest - coalesce(more, 0)").alias("rest")), "rest")
    left = store(short.where("p > 0").unionByName(open_long.join(picked[0], "row", "left_anti")), "left")
    for step in ("short", "fit", "nearest"):
        if step == "nearest":
            got = nearest(left, rest.withColumn("must", F.lit(False)), sources)
        else:
            room = left.join(small(rest.withColumnRenamed("rest", "room"), sources), "key").where("size <= room").drop("room")
            got = runs(left.where("NOT long") if step == "short" else room, rest, buckets, sources)
        got = store(got, "picked")
        picked.append(got)
        rest = store(rest.join(words_of(left, got), "key", "left").select("key", F.expr("rest - coalesce(used, 0)").alias("rest")), "rest")
        left = store(left.join(got, "row", "left_anti"), "left")
    chosen = picked[0].unionByName(picked[1]).unionByName(picked[2]).unionByName(picked[3]).select("row", F.lit(1).alias("extra"))
    many = drawn.unionByName(short).select("row", "whole").join(chosen, "row", "left").select("row", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("n"))
    return sizes.join(many, "row", "left").join(small(goal, sources), "key").select(
        "doc_id", "size", "source_size", "target", (F.coalesce("n", F.lit(0)) * F.col("size")).cast("long").alias("taken"),
        F.coalesce("n", F.lit(0)).cast("long").alias("copies"), "source")
