"""Aggregations: usage and cost, sizes, coverage checks, summaries, buckets, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.operators.ranking import full_rank, top_per_group


def price_table(spark) -> DataFrame:
    rows = [(m, str(i), str(o)) for m, (i, o) in K.PRICES.items()]
    df = spark.createDataFrame(rows, "model string, usd_in string, usd_out string")
    return df.select("model", F.col("usd_in").cast("decimal(10,4)").alias("usd_in"), F.col("usd_out").cast("decimal(10,4)").alias("usd_out"))


def with_cost(usage: DataFrame, unknown: str = "zero") -> DataFrame:
    """Adds ``cost`` in exact millionths of a USD; an unlisted model costs 0 (``zero``) or null (``null``).

    Decimal sums do not depend on the order in which tasks finish; ``usd`` turns them into USD.
    """
    j = usage.join(F.broadcast(price_table(usage.sparkSession)), "model", "left")  # four fixed rows
    cost = (F.col("prompt_tokens") * F.col("usd_in") + F.col("completion_tokens") * F.col("usd_out")).cast("decimal(28,4)")
    return j.withColumn("cost", F.coalesce(cost, F.lit(0).cast("decimal(28,4)")) if unknown == "zero" else cost).drop("usd_in", "usd_out")


def usd(micro: Column) -> Column:
    """USD with six decimals from exact millionths."""
    return F.round(micro, 0).cast("double") / 1e6


def usage_by_model(usage: DataFrame) -> DataFrame:
    """Tokens, calls and cost by model plus a grand total row (null model)."""
    return with_cost(usage).rollup("model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.count("*").alias("calls"), usd(F.sum("cost")).alias("cost"))


def usage_cost(usage: DataFrame, key: str, unknown: str) -> DataFrame:
    """Cost per key; under the ``null`` policy one unknown call makes the key's total null."""
    c = with_cost(usage, unknown).groupBy(key).agg(F.sum("cost").alias("c"), F.count_if(F.col("cost").isNull()).alias("unknown"))
    total = F.when(F.col("unknown") > 0, None).otherwise(usd(F.col("c"))) if unknown == "null" else usd(F.col("c"))
    return c.select(key, total.alias("cost"), "unknown")


def stage_report(calls: DataFrame, stages: list[str]) -> DataFrame:
    """Stages in fixed order, missing ones as zero rows, and a total row (null stage)."""
    dim = calls.sparkSession.createDataFrame(list(enumerate(stages)), "ord int, stage string")
    g = calls.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"))
    rows = F.broadcast(dim).join(g, "stage", "left").fillna(0, ["calls", "p", "c"])
    return rows.groupingSets([["ord", "stage"], []], "ord", "stage").agg(
        F.sum("calls").alias("calls"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"))


def size_distribution(sizes: DataFrame, key: str) -> DataFrame:
    """Per key over its room sizes: count, min, max, mean, empties, max/min, spread."""
    return sizes.groupBy(key).agg(
        F.count("*").alias("rooms"), F.min("size").alias("min"), F.max("size").alias("max"), F.round(F.avg("size"), 2).alias("mean"),
        F.count_if(F.col("size") == 0).alias("empty"),
        F.round(F.max("size") / F.nullif(F.min("size"), F.lit(0)), 4).alias("ratio"), F.round(F.stddev_pop("size"), 4).alias("std"))


def coverage_violations(rooms: DataFrame, entities: DataFrame, key: str, max_rooms: int, budget: int) -> DataFrame:
    """Rows that break an invariant: too many rooms, too many kept, an entity not placed exactly once."""
    n = rooms.groupBy(key).agg(F.count_distinct("section").alias("value")).where(F.col("value") > max_rooms)
    kept = rooms.where("status = 'kept'").groupBy(key, "section").agg(F.count("*").alias("value")).where(F.col("value") > budget)
    placed = rooms.groupBy(key, "title").agg(F.count("*").alias("n"))
    once = entities.select(key, "title").join(placed, [key, "title"], "left").where(F.coalesce("n", F.lit(0)) != 1)
    return (
        n.select(key, F.lit("room_count").alias("check"), "value")
        .unionByName(kept.select(key, F.lit("kept_over_budget").alias("check"), "value"))
        .unionByName(once.select(key, F.lit("placed_once").alias("check"), F.coalesce("n", F.lit(0)).alias("value"))))


def keep_demote_totals(rooms: DataFrame, key: str, room: str) -> DataFrame:
    """Kept and demoted per room, per key and overall (rollup)."""
    return rooms.groupBy(key, room, "status").agg(F.count("*").alias("n")).rollup(key, room).agg(
        F.sum(F.when(F.col("status") == "kept", F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(F.col("status") == "demoted", F.col("n")).otherwise(0)).alias("demoted"), F.sum("n").alias("total"))


def dominance_summary(dom: DataFrame) -> DataFrame:
    """One row: mean, median and threshold shares of the dominance ratio and of chapters touched."""
    def share(c: Column) -> Column:
        return F.round(F.avg(c.cast("double")), 4)

    r, n = F.col("ratio"), F.col("touched")
    return dom.agg(
        F.round(F.avg(r), 4).alias("mean"), F.round(F.median(r), 4).alias("median"), share(r >= 0.5).alias("ge_05"),
        share(r >= 0.6).alias("ge_06"), share(r >= 0.8).alias("ge_08"), F.round(F.avg(n), 4).alias("touched_mean"),
        F.median(n).alias("touched_median"), share(n == 1).alias("touched_1"), share(n <= 2).alias("touched_le_2"))


def verdict(summary: DataFrame, clean: float = 0.80, touched: float = 2.0) -> DataFrame:
    """GO / CONDITIONAL / NO-GO from landing rate, chapters touched, the special anchor and split anchors."""
    clr, nt = F.col("ge_05") >= clean, F.col("touched_mean") <= touched
    special, anchors = F.col("special_ok"), F.col("split_anchors") == 0
    return summary.withColumn("verdict", F.when(clr & nt & special & anchors, "GO").when(~clr & (~anchors | ~special), "NO-GO").otherwise("CONDITIONAL"))


def room_payload(members: DataFrame, communities: DataFrame, reports: DataFrame, n: int = 10) -> DataFrame:
    """Per community: report title, summary, size and its best ``n`` members (a bounded list)."""
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    top = top_per_group(members, ["community"], [F.desc("degree"), "title"], n).groupBy("community").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), "|").alias("members"))
    return communities.join(reports.select("community", F.col("title").alias("report"), "summary"), "community").join(size, "community").join(
        top, "community").select("community", "report", "summary", "size", "members")


def building_slots(groups: DataFrame, members: DataFrame, titles: DataFrame) -> DataFrame:
    """(building, ord, concept, degree, name, summary, size): distinct members of a group in loci order.

    ``groups`` maps few communities to a building; members stay rows and are ranked in two levels,
    so a building with a third of all members is not ranked in one task.
    """
    sized = members.groupBy("community").agg(F.count("*").alias("n")).join(groups, "community").join(titles, "community")
    head = sized.groupBy("building").agg(
        F.min_by("title", F.struct(-F.col("n"), "community")).alias("name"),
        F.concat(F.lit("이 건물: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", "title"))), lambda x: x["title"]), ", ")).alias("summary"))
    uniq = members.join(groups, "community").select("building", "id", F.col("title").alias("concept"), "degree").distinct()
    size = uniq.groupBy("building").agg(F.count("*").alias("size"))
    ranked = full_rank(uniq, ["building"], -F.col("degree"), [F.desc("degree"), "concept"], "ord")
    return ranked.join(head, "building").join(size, "building").select("building", "ord", "concept", "degree", "name", "summary", "size")


def partition_check(expected: DataFrame, assigned: DataFrame, item: str, label: str, k: int) -> DataFrame:
    """(check, item, n): missing, duplicate, unexpected items, labels out of range, wrong label count."""
    got = assigned.groupBy(item).agg(F.count("*").alias("n"))
    e = expected.select(item).distinct().withColumn("_e", F.lit(True))
    j = e.join(got, item, "full")
    def rows(cond, name):
        return j.where(cond).select(F.lit(name).alias("check"), F.col(item).cast("string").alias("item"), F.coalesce("n", F.lit(0)).alias("n"))
    bad = assigned.where(~F.col(label).between(0, k - 1)).select(F.lit("label_range").alias("check"), F.col(item).cast("string").alias("item"), F.lit(1).cast("long").alias("n"))
    wrong = assigned.agg(F.count_distinct(label).alias("n")).where(F.col("n") != k).select(F.lit("wrong_k").alias("check"), F.lit(None).cast("string").alias("item"), "n")
    return (rows("n is null", "missing").unionByName(rows("n > 1", "duplicate")).unionByName(rows("_e is null", "unexpected"))
            .unionByName(bad).unionByName(wrong))


def type_bucket(c: Column) -> Column:
    """Struct (side, bucket): the first bucket with a keyword inside the type name."""
    out = None
    for side, name, kws in K.TYPE_BUCKETS:
        hit = F.lit(False)
        for kw in kws:
            hit = hit | c.contains(kw)
        val = F.struct(F.lit(side).alias("side"), F.lit(name).alias("bucket"))
        out = F.when(hit, val) if out is None else out.when(hit, val)
    return out.otherwise(F.struct(F.lit("unknown").alias("side"), F.lit("unknown").alias("bucket")))


def bucket_counts(df: DataFrame, kind: str, title: str, order: str, examples: int = 5) -> DataFrame:
    """Rows per bucket with the first few titles in table order."""
    b = df.withColumn("_b", type_bucket(F.col(kind))).withColumns({"side": F.col("_b.side"), "bucket": F.col("_b.bucket")})
    n = b.groupBy("side", "bucket").agg(F.count("*").alias("n"))
    ex = top_per_group(b, ["side", "bucket"], [order], examples).groupBy("side", "bucket").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(title).alias("t")))), lambda x: x["t"]), ", ").alias("examples"))
    return n.join(ex, ["side", "bucket"])


def degree_vs_type(ents: DataFrame, homed: DataFrame, n: int = 20) -> DataFrame:
    """Per room: who is shown by degree top-n, by keep-type (homed orphans included), or by both."""
    deg = top_per_group(ents, ["room"], [F.desc("degree"), "title"], n).select("room", "id", F.lit(True).alias("d"))
    both = ents.select("room", "id", "type").unionByName(homed.select("room", "id", "type"))
    typ = both.where(type_bucket(F.col("type"))["side"] == "keep").select("room", "id", F.lit(True).alias("t"))
    return deg.join(typ, ["room", "id"], "full").select(
        "room", "id", F.coalesce("d", F.lit(False)).alias("by_degree"), F.coalesce("t", F.lit(False)).alias("by_type"))


def theme_cohesion(themes: DataFrame, clusters: DataFrame, item: str) -> DataFrame:
    """Per theme: its most common cluster (smallest on ties), that count, members found and not found."""
    j = themes.join(clusters, item, "left")
    per = j.groupBy("theme", "cluster").agg(F.count("*").alias("n"))
    return per.groupBy("theme").agg(
        F.min_by("cluster", F.when(F.col("cluster").isNotNull(), F.struct(-F.col("n"), "cluster"))).alias("mode_cluster"),
        F.max(F.when(F.col("cluster").isNotNull(), F.col("n"))).alias("mode_count"),
        F.sum(F.when(F.col("cluster").isNotNull(), F.col("n")).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("cluster").isNull(), F.col("n")).otherwise(0)).alias("not_found"))


def tie_clusters(df: DataFrame, key: str) -> DataFrame:
    """(size, n_values): how many values are shared by exactly ``size`` rows."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_values"))


def offset_stats(ordered: DataFrame, room: list[str]) -> DataFrame:
    """Fine, fallback and unresolved counts with shares, and the rooms whose kept members don't ascend by position."""
    kept = F.col("status") == "kept"
    before = F.lag("pos").over(Window.partitionBy(*room, "status").orderBy("rank"))  # the members of one room
    falls = kept & (before > F.col("pos"))
    rows = ordered.withColumn("falls", F.coalesce(falls, F.lit(False)))
    bad = F.count_distinct(F.when(F.col("falls"), F.struct(*room)))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("pos_source") == 0).alias("fine"), F.count_if(F.col("pos_source") != 0).alias("fallback"),
        F.count_if(F.col("pos_source") == 2).alias("unresolved"), bad.alias("unsorted_rooms")).withColumn("fine_share", F.round(F.col("fine") / F.col("n"), 4)).withColumn(
        "sorted", F.col("unsorted_rooms") == 0)


def readiness(status: DataFrame) -> DataFrame:
    """One row: any ready, all ready, count per state."""
    return status.agg(
        F.coalesce(F.bool_or(F.col("status") == "ok"), F.lit(False)).alias("any_ready"), F.coalesce(F.every(F.col("status") == "ok"), F.lit(False)).alias("all_ready"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pending", "error", "ok", "warming")])
