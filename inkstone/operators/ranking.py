"""Ranking operators: top-k, full ranks of unbounded groups, stable ids, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.session import cut_lineage


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """Best ``n`` rows per key. The rank filter is pushed below the shuffle (window group limit),
    so a hot key ships at most ``n`` rows from each input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def full_rank(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """``row_number`` over (keys, order) without bringing a whole key into one task.

    ``bucket`` is a deterministic value that never decreases along ``order``; rows are numbered
    inside (keys, bucket) and shifted by the row counts of the earlier buckets, which come from a
    partial aggregate. Choose buckets finer than a hot key, such as the leading order columns.
    """
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = b.withColumn("_l", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    # buckets are never null: null order values fall into their own bucket through the struct
    return local.join(shift, ["_b", *keys]).withColumn(name, (F.col("_l") + F.col("_shift")).cast("long")).drop("_b", "_l", "_shift")


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``row_number`` over the whole table without one task for all rows.

    Rows are dealt by ranges of ``order`` and sorted inside their range; a row's place there plus the sizes of the
    ranges before it is its rank. Only one count per range meets in one task. Places are stored before they are counted,
    because a lost task might draw the ranges anew.
    """
    at = F.monotonically_increasing_id()  # range number above 33 bits of place
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    shift = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_shift"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return placed.join(F.broadcast(shift), "_range").withColumn(name, place + F.col("_shift") + 1).drop("_at", "_range", "_shift")  # a row per range


def round_robin(df: DataFrame, keys: list[str], kind: str, degree: str, title: str, n: int) -> DataFrame:
    """First ``n`` per key taking one of each kind per round, kinds in order of their best member.

    Only the best ``n`` of every (key, kind) can be chosen, so the group is cut before ranking.
    """
    order = [F.desc(degree), title]
    cut = top_per_group(df, [*keys, kind], order, n, "_round")
    first = df.groupBy(*keys, kind).agg(F.min(F.struct((-F.col(degree)).alias("d"), F.col(title).alias("t"))).alias("_head"))
    j = cut.join(first, [*keys, kind])
    return top_per_group(j, keys, ["_round", "_head"], n, "rank").drop("_round", "_head")


def unique_ids(titles: DataFrame, base: str, seen: str, bucket: Column) -> DataFrame:
    """First-seen titles keep their base id, later ones of the same base get _2, _3, ..

    A suffixed id can equal an id another title already holds. Then the later-seen title, and
    the later titles of its base, move one suffix on; this repeats until all ids differ.
    """
    out = full_rank(titles, [base], bucket, [seen], "_n")
    uid = F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("_n").cast("string")))
    while True:
        out = out.withColumn("uid", uid)
        owner = out.groupBy("uid").agg(F.min(seen).alias("_first"), F.count("*").alias("_c")).where("_c > 1")
        lost = out.join(owner, "uid").where(F.col(seen) != F.col("_first")).groupBy(base).agg(F.min("_n").alias("_from"))
        if lost.isEmpty():
            return out.drop("_n")
        moved = out.join(lost, base, "left")
        out = cut_lineage(moved.withColumn("_n", F.col("_n") + F.coalesce((F.col("_n") >= F.col("_from")).cast("int"), F.lit(0))).drop("_from", "uid"))


def seeded_order(seed: int, *keys: Column) -> Column:
    """A hash order that is the same on every run and in every engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows in seeded hash order (a distributed top-n)."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def dual_rank(members: DataFrame, room: list[str], weight: str, pos: str, tie: list[str]) -> DataFrame:
    """Rank in room and over everything by weight desc, position asc; with the room's total weight."""
    order = [F.desc(weight), pos, *tie]
    slots = F.struct((-F.col(weight)).alias("w"), F.floor(F.col(pos) / 256).alias("p"))
    r = full_rank(members, room, slots, order, "room_rank")
    g = global_rank(r, order, "global_rank")
    total = members.groupBy(*room).agg(F.sum(weight).cast("long").alias("room_weight"))
    return g.join(total, room)


def padded(number: Column, width: int) -> Column:
    """A number with leading zeros; longer numbers keep all their digits."""
    s = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(s))), s)


def blind_relabel(df: DataFrame, label: str, prefix: str) -> DataFrame:
    """(label, blind): neutral ids by sorted order of the distinct labels."""
    r = global_rank(df.select(label).distinct(), [label], "_r")
    return r.select(label, F.concat(F.lit(prefix), padded(F.col("_r"), 6)).alias("blind"))
