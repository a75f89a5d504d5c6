"""Connected groups from bucketed candidates, without all pairs of a tight bucket.

Rows (bucket, id, ..) say which ids must be compared: those that share a bucket. In pivot rounds every id of a bucket is
verified against one member; ids already in one group need no comparison with each other. Only what the rounds leave
apart is then compared pair by pair, group against group, so every verified link between groups is found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import store
from inkstone.operators.graph import components

#: A condition on two struct columns of members.
Near = Callable[[str, str], F.Column]
#: Rounds with one pivot a bucket before the pairs that are left are compared.
ROUNDS = 2
#: Members of a bucket up to which all its pairs are compared at the end, if ``beyond`` takes the larger ones.
LARGE = 16


def grouped(buckets: DataFrame, near: Near, last: Near, verify: Callable[[DataFrame], DataFrame],
            order: str = "id", refine: Callable[[DataFrame], DataFrame] | None = None,
            beyond: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) of all ids with a verified link; ``component`` is the smallest id of the group.

    ``near(a, b)`` is a cheap condition on the struct columns ``a`` and ``b`` of a candidate pair that holds for every
    true link; ``verify`` keeps the true links of a table of pairs (a, b), a < b. The first pivot of a bucket has the smallest
    ``order``. For the last, pairwise comparison ``refine`` may add columns to (id) rows and ``last`` is the condition.
    ``beyond`` gives pairs (id, j) that hold every true link between groups of the rows (bucket, x, g) of larger buckets.
    """
    cols = [c for c in buckets.columns if c != "bucket"]
    rows = buckets.select("bucket", F.struct(*cols).alias("x"))
    label: DataFrame | None = None
    edges: DataFrame | None = None
    for k in range(ROUNDS + 1):
        if label is None:
            mixed = rows.withColumn("g", F.col("x.id"))
        else:
            known = rows.join(label.select(F.col("id").alias("i"), "component"), F.col("x.id") == F.col("i"), "left").select(
                "bucket", "x", F.coalesce("component", "x.id").alias("g"))
            apart = known.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("bucket", "m")
            mixed = store(known.join(apart, "bucket"), "mixed")
            if mixed.isEmpty():
                break
        if k < ROUNDS:
            first = F.col(f"x.{order}") if k == 0 else F.xxhash64("x.id", F.lit(k))
            pivot = mixed.groupBy("bucket").agg(F.min(F.struct(first.alias("o"), F.col("x").alias("y"), F.col("g").alias("h"))).alias("p"))
            pairs = mixed.join(pivot, "bucket").where("g <> p.h").select("x", F.col("p.y").alias("y"))
        else:
            large = mixed.where(F.col("m") > LARGE).drop("m") if beyond is not None else None
            mixed = mixed if beyond is None else mixed.where(F.col("m") <= LARGE)
            if refine is not None:
                more = refine(mixed.select("x.id").distinct())
                extra = [c for c in more.columns if c != "id"]
                mixed = mixed.join(more.withColumnRenamed("id", "i"), F.col("x.id") == F.col("i")).select(
                    "bucket", "g", F.struct("x.*", *extra).alias("x"))
            other = mixed.select("bucket", F.col("x").alias("y"), F.col("g").alias("h"))
            pairs = mixed.join(other, "bucket").where("g < h").select("x", "y")
        pairs = pairs.where((near if k < ROUNDS else last)("x", "y"))
        if k == 0:
            # one pair an id is enough at first: with the pivot that comes first of all
            pairs = pairs.groupBy("x.id").agg(F.min(F.struct(f"y.{order}", F.col("y.id").alias("j"))).alias("q")).select("id", "q.j")
        else:
            pairs = pairs.select("x.id", F.col("y.id").alias("j"))
        if k == ROUNDS and large is not None and not large.isEmpty():
            pairs = pairs.unionByName(beyond(large))
        links = verify(pairs.select(F.least("id", "j").alias("a"), F.greatest("id", "j").alias("b")).distinct())
        edges = store(links if edges is None else edges.unionByName(links).distinct(), "links")
        label = components(edges.select(F.col("a").alias("source"), F.col("b").alias("target"))).withColumnRenamed("title", "id")
    return label
