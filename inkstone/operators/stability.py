"""Run-to-run stability of votes and rooms: majority, jaccard, flips, matching, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.operators.ranking import top_per_group
from inkstone.session import cut_lineage

LATE = 1_000_000


def tally(votes: DataFrame) -> DataFrame:
    """(room, title, votes, n_seen, first_ord): keep votes of every title over all runs."""
    return votes.groupBy("room", "title").agg(
        F.sum(F.col("keep").cast("int")).cast("int").alias("votes"), F.count("*").cast("int").alias("n_seen"),
        F.min(F.when((F.col("run") == 0) & F.col("keep"), F.col("ord"))).alias("first_ord"))


def majority_keep(votes: DataFrame, n_runs: int, budget: int) -> DataFrame:
    """(room, title, votes, status, rank): majority titles by votes, first-run order, title, cut to budget."""
    t = tally(votes)
    best = top_per_group(
        t.where(F.col("votes") > n_runs / 2), ["room"],
        [F.desc("votes"), F.coalesce("first_ord", F.lit(1 << 60)), "title"], budget)
    return t.join(best.select("room", "title", "rank"), ["room", "title"], "left").select(
        "room", "title", "votes", F.when(F.col("rank").isNotNull(), "kept").otherwise("demoted").alias("status"), "rank")


def pair_jaccard(votes: DataFrame, n_runs: int, on_empty: str = "one") -> DataFrame:
    """(room, run_a, run_b, jaccard) of keep sets for every pair of runs.

    A title carries the short list of runs that keep it (at most ``n_runs``), so shared titles are
    counted by one aggregate; no two titles of a room are ever paired.
    """
    kept = votes.where("keep").groupBy("room", "title").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    pairs = F.flatten(F.transform("runs", lambda a: F.transform(
        F.filter("runs", lambda b: b > a), lambda b: F.struct(a.alias("run_a"), b.alias("run_b")))))
    inter = kept.select("room", F.inline(pairs)).groupBy("room", "run_a", "run_b").agg(F.count("*").alias("both"))
    size = votes.groupBy("room", "run").agg(F.sum(F.col("keep").cast("int")).alias("n"))
    runs = F.sequence(F.lit(0), F.lit(n_runs - 1))
    grid = votes.select("room").distinct().select("room", F.explode(F.flatten(F.transform(runs, lambda a: F.transform(
        F.filter(runs, lambda b: b > a), lambda b: F.struct(a.alias("run_a"), b.alias("run_b")))))).alias("p")).select("room", "p.*")
    a = size.select("room", F.col("run").alias("run_a"), F.col("n").alias("na"))
    b = size.select("room", F.col("run").alias("run_b"), F.col("n").alias("nb"))
    j = grid.join(a, ["room", "run_a"], "left").join(b, ["room", "run_b"], "left").join(inter, ["room", "run_a", "run_b"], "left")
    j = j.fillna(0, ["na", "nb", "both"]).withColumn("u", F.col("na") + F.col("nb") - F.col("both"))
    if on_empty == "skip":
        j = j.where("u > 0")
    return j.select("room", "run_a", "run_b", F.when(F.col("u") == 0, 1.0).otherwise(F.col("both") / F.col("u")).alias("jaccard"))


def split_titles(votes: DataFrame, n_runs: int, budget: int) -> DataFrame:
    """Per room and in total: titles some but not all runs keep, and majority changes incl. budget cuts."""
    t = tally(votes)
    per = t.groupBy("room").agg(
        F.count("*").alias("n_titles"), F.sum(((F.col("votes") > 0) & (F.col("votes") < n_runs)).cast("long")).alias("n_split"),
        F.sum((F.col("votes") > n_runs / 2).cast("long")).alias("n_majority"))
    per = per.withColumn("changed", F.col("n_split") + F.greatest(F.lit(0), F.col("n_majority") - budget))
    return per.rollup("room").agg(*[F.sum(c).alias(c) for c in ("n_titles", "n_split", "changed")]).withColumn(
        "fraction", F.round(F.col("n_split") / F.col("n_titles"), 4))


def flip_rate(votes: DataFrame, n_runs: int, subset: DataFrame | None = None) -> DataFrame:
    """(flipped, total, rate): a title flips when its class differs across runs; absence is a class."""
    t = votes.groupBy("title").agg(
        F.count_distinct("run").alias("seen"), F.min("keep").alias("lo"), F.max("keep").alias("hi"))
    if subset is not None:
        t = t.join(subset.select("title").distinct(), "title", "left_semi")
    flipped = (F.col("lo") != F.col("hi")) | (F.col("seen") < n_runs)
    return t.agg(F.sum(flipped.cast("long")).alias("flipped"), F.count("*").alias("total")).withColumn(
        "rate", F.coalesce(F.col("flipped") / F.nullif("total", F.lit(0)), F.lit(0.0)))


def room_pairs(members: DataFrame, n_runs: int) -> DataFrame:
    """(run_a, run_b, a, b, jaccard > 0) of room member sets across every pair of runs.

    Titles carry their room in each run (one short array per title); pairs come from that array.
    """
    runs = members.groupBy("title").agg(F.array_sort(F.collect_set(F.struct("run", "room"))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x: F.transform(
        F.filter("r", lambda y: y["run"] > x["run"]),
        lambda y: F.struct(x["run"].alias("run_a"), y["run"].alias("run_b"), x["room"].alias("a"), y["room"].alias("b")))))
    both = runs.select(F.inline(pairs)).groupBy("run_a", "run_b", "a", "b").agg(F.count("*").alias("n"))
    size = members.groupBy("run", "room").agg(F.count_distinct("title").alias("s"))
    sa = size.select(F.col("run").alias("run_a"), F.col("room").alias("a"), F.col("s").alias("sa"))
    sb = size.select(F.col("run").alias("run_b"), F.col("room").alias("b"), F.col("s").alias("sb"))
    j = both.join(sa, ["run_a", "a"]).join(sb, ["run_b", "b"])
    return j.select("run_a", "run_b", "a", "b", (F.col("n") / (F.col("sa") + F.col("sb") - F.col("n"))).alias("jaccard"))


def greedy_match(pairs: DataFrame, scope: list[str], left: str, right: str, score: str) -> DataFrame:
    """Greedy one-to-one matching by (score, left, right) descending, done in parallel rounds.

    A pair that is the best one of both its ends is what the sequential greedy would take, since
    the order is total; such pairs are taken together, their ends removed, and the rest repeated.
    """
    rest, taken = cut_lineage(pairs), None
    key = F.struct(score, left, right)
    while not rest.isEmpty():
        a = rest.groupBy(*scope, left).agg(F.max(key).alias("ka"))
        b = rest.groupBy(*scope, right).agg(F.max(key).alias("kb"))
        best = rest.join(a, [*scope, left]).join(b, [*scope, right]).where((key == F.col("ka")) & (key == F.col("kb")))
        best = cut_lineage(best.select(*pairs.columns))
        taken = best if taken is None else taken.unionByName(best)
        rest = cut_lineage(
            rest.join(best.select(*scope, left), [*scope, left], "left_anti").join(best.select(*scope, right), [*scope, right], "left_anti"))
    return taken if taken is not None else pairs


def pair_stats(members: DataFrame, matches: DataFrame) -> DataFrame:
    """Per pair of runs: matched jaccard mean and min, moved rooms and visibility over common titles."""
    a = members.select("title", F.col("run").alias("run_a"), F.col("room").alias("a"), F.col("keep").alias("vis_a"))
    b = members.select("title", F.col("run").alias("run_b"), F.col("room").alias("b"), F.col("keep").alias("vis_b"))
    common = a.join(b, "title").where("run_a < run_b")
    home = matches.select("run_a", "run_b", "b", F.col("a").alias("canon"))
    c = common.join(home, ["run_a", "run_b", "b"], "left")
    moved = c.groupBy("run_a", "run_b").agg(
        F.count("*").alias("common"), F.sum((F.col("canon").isNull() | (F.col("canon") != F.col("a"))).cast("long")).alias("moved_room"),
        F.sum((F.col("vis_a") != F.col("vis_b")).cast("long")).alias("moved_visibility"))
    m = matches.groupBy("run_a", "run_b").agg(
        F.round(F.avg("jaccard"), 4).alias("mean_jaccard"), F.round(F.min("jaccard"), 4).alias("min_jaccard"), F.count("*").alias("n_matched"))
    return moved.join(m, ["run_a", "run_b"], "left").withColumns({
        "moved_room_fraction": F.round(F.col("moved_room") / F.greatest("common", F.lit(1)), 4),
        "moved_visibility_fraction": F.round(F.col("moved_visibility") / F.greatest("common", F.lit(1)), 4)})


def anchor_stability(anchors: DataFrame, votes: DataFrame, n_runs: int) -> DataFrame:
    """Per anchor: in how many runs it is visible, and whether in all / any."""
    v = votes.groupBy("title").agg(F.count_distinct(F.when(F.col("keep"), F.col("run"))).alias("visible"))
    return anchors.join(v, "title", "left").select(
        "title", F.coalesce("visible", F.lit(0)).alias("visible_in_n_runs"),
        (F.coalesce("visible", F.lit(0)) == n_runs).alias("in_all"), (F.coalesce("visible", F.lit(0)) > 0).alias("in_any"))


def anchor_eval(anchors: DataFrame, aliases: DataFrame, spec: DataFrame) -> DataFrame:
    """Per anchor: missing, or present with its class and whether that class is the wanted one."""
    named = anchors.join(aliases, "title", "left").withColumn("actual", F.coalesce("alias", "title"))
    s = spec.select(F.col("title").alias("actual"), F.col("status").alias("class"), F.col("room"))
    return named.join(s, "actual", "left").select(
        "title", "should", F.when(F.col("class").isNull(), "missing").otherwise("present").alias("status"), "class", "room",
        (F.col("class") == F.when(F.col("should") == "keep", "kept").otherwise("demoted")).alias("correct"))


def cohabit(groups: DataFrame, spec: DataFrame) -> DataFrame:
    """Per group of anchors: members, present ones, distinct rooms, and whether all share one room."""
    j = groups.join(spec.select("title", "room"), "title", "left")
    return j.groupBy("grp").agg(
        F.count("*").alias("members"), F.count("room").alias("present"), F.count_distinct("room").alias("n_rooms")).withColumn(
        "all_same_room", (F.col("n_rooms") == 1) & (F.col("present") == F.col("members")))


def same_partition(a: DataFrame, b: DataFrame, item: str, label: str) -> DataFrame:
    """Groups of two labelings compared without looking at the label names.

    A group's signature is its size and an order-free sum of item hashes, a partial aggregate;
    member lists are never built. (signature size, in_a, in_b) for groups found on one side only
    or on both.
    """
    def sig(df: DataFrame) -> DataFrame:
        h = F.xxhash64(F.col(item)).cast("decimal(38,0)")
        h2 = F.xxhash64(F.lit(17), F.col(item)).cast("decimal(38,0)")
        return df.groupBy(label).agg(F.count("*").alias("size"), F.sum(h).alias("h"), F.sum(h2).alias("h2")).select("size", "h", "h2")

    x, y = sig(a).withColumn("in_a", F.lit(True)), sig(b).withColumn("in_b", F.lit(True))
    return x.join(y, ["size", "h", "h2"], "full").select(
        "size", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
