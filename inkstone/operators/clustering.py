"""Clustering of entity vectors on MLlib; only per-cluster summaries are ever brought together."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import vectors as VEC
from inkstone.operators.folds import fold_sorted
from inkstone.session import cut_lineage

MAX_CLUSTERS = 4096  # rows of a cluster summary table


def unit_features(df: DataFrame, item: str, vector: str) -> DataFrame:
    return df.select(item, VEC.normalize(F.col(vector)).alias("unit")).withColumn("features", array_to_vector("unit"))


def base_cluster(features: DataFrame, item: str, k: int, seed: int = 42) -> DataFrame:
    """(item, label) with exactly the asked number of clusters unless points coincide; k > n is an error."""
    n = features.count()
    if k > n:
        raise ValueError(f"k={k} is larger than the number of rows {n}")
    if k == 1:
        return features.select(item, F.lit(0).alias("label"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(features)
    return model.transform(features).select(item, F.col("label").cast("int").alias("label"))


FAN, LLOYD = 16, 10  # parts a cluster is cut into at once, rounds of assignment at most


def split_oversized(features: DataFrame, labels: DataFrame, item: str, max_size: int, seed: int = 42) -> DataFrame:
    """Clusters above ``max_size`` are cut into ceil(size / max) parts, at most ``FAN`` at once, until all fit.

    All oversized clusters are refined together: the first centres are items drawn by hash, each item takes the nearest
    centre of its own cluster, and the centres become means, until no item changes. A cluster that does not fall apart
    (coinciding vectors) is marked and left. A round is a fixed number of jobs, however many clusters it cuts.
    """
    if max_size < 2:
        raise ValueError("max_size must be at least 2")
    units = features.select(item, "unit")
    cur = cut_lineage(labels.select(item, F.col("label").cast("string").alias("label"), F.lit(False).alias("whole")))
    while True:
        size = cur.groupBy("label").agg(F.count("*").alias("n"), F.bool_and("whole").alias("whole"))
        big = cut_lineage(size.where((F.col("n") > max_size) & ~F.col("whole")).select(
            "label", F.least(F.lit(FAN), F.greatest(F.lit(2), F.ceil(F.col("n") / max_size))).cast("int").alias("k")))
        if big.isEmpty():
            return cur.select(item, "label")
        rows = cut_lineage(units.join(cur.join(_small(big), "label").select(item, "label", "k"), item))
        drawn = F.xxhash64(F.lit(seed), F.col(item))
        first = rows.groupBy("label", F.pmod(drawn, F.col("k")).alias("sub")).agg(F.min_by("unit", F.struct(drawn, F.col(item))).alias("centre"))
        part = None
        for _ in range(LLOYD):
            centres = first.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("sub", "centre"))).alias("cs"))  # at most FAN
            near = F.array_min(F.transform("cs", lambda c: F.struct((-VEC.dot(c["centre"], F.col("unit"))).alias("s"), c["sub"].alias("sub"))))["sub"]
            new = cut_lineage(rows.join(_small(centres), "label").select(item, "label", "unit", near.alias("sub")))
            if part is not None and new.join(part.select(item, F.col("sub").alias("was")), item).where("sub <> was").isEmpty():
                break
            part = new
            long = part.select("label", "sub", F.posexplode("unit").alias("pos", "x")).groupBy("label", "sub", "pos").agg(F.sum("x").alias("x"))
            first = long.groupBy("label", "sub").agg(VEC.normalize(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])).alias("centre"))
        parts = part.groupBy("label").agg(F.count_distinct("sub").alias("parts"))
        cut = part.join(_small(parts), "label").select(
            item, F.when(F.col("parts") > 1, F.concat("label", F.lit("."), F.col("sub").cast("string"))).otherwise(F.col("label")).alias("new"), (F.col("parts") == 1).alias("stuck"))
        cur = cut_lineage(cur.join(cut, item, "left").select(item, F.coalesce("new", "label").alias("label"), (F.col("whole") | F.coalesce("stuck", F.lit(False))).alias("whole")))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast while it is a short table of clusters, joined by shuffle beyond that."""
    return F.broadcast(table) if table.count() <= MAX_CLUSTERS else table


def centroids(features: DataFrame, labels: DataFrame, item: str) -> DataFrame:
    """(label, n, total, centroid): member count, sum of unit vectors and re-normalised mean per cluster."""
    j = features.select(item, "unit").join(labels.select(item, "label"), item)
    long = j.select("label", F.posexplode("unit").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"))
    vec = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    return vec.join(n, "label").select("label", "n", F.transform("p", lambda s: s["x"]).alias("total")).withColumn("centroid", VEC.normalize(F.col("total")))


def _summaries(cent: DataFrame) -> DataFrame:
    """The cluster summary table under one key, refused when it is not small."""
    n = cent.agg(F.count("*").alias("_n"))
    ok = F.when(F.col("_n") > MAX_CLUSTERS, F.raise_error(F.lit("too many clusters to merge at once"))).otherwise(F.lit(0))
    return cent.join(F.broadcast(n)).select(ok.alias("g"), "label", "n", "total", "centroid")


def _ward_groups(points: np.ndarray, k: int) -> list[int]:
    """Group number per point after joining, at each step, the pair whose union adds least variance."""
    groups = {i: [i] for i in range(len(points))}
    while len(groups) > k:
        ids = sorted(groups)
        mean = np.array([points[groups[i]].mean(axis=0) for i in ids])
        size = np.array([len(groups[i]) for i in ids], dtype=float)
        gap = ((mean[:, None, :] - mean[None, :, :]) ** 2).sum(axis=2)
        cost = gap * (size[:, None] * size[None, :]) / (size[:, None] + size[None, :])
        cost[np.tril_indices(len(ids))] = np.inf
        a, b = np.unravel_index(np.argmin(cost), cost.shape)
        groups[ids[a]] += groups.pop(ids[b])
    out = [0] * len(points)
    for new, i in enumerate(sorted(groups)):
        for p in groups[i]:
            out[p] = new
    return out


def merge_to_k(features: DataFrame, labels: DataFrame, item: str, k: int) -> DataFrame:
    """(item, label, merged): clusters joined to ``k`` groups by their unit-mean centroids.

    The variance-minimal merging runs on the cluster summaries only (one row per cluster).
    """
    def merge(key, rows):
        pts = np.array([r[4] for r in rows], dtype=float)
        return [(r[1], g) for r, g in zip(rows, _ward_groups(pts, min(k, len(rows))))]

    plan = fold_sorted(_summaries(centroids(features, labels, item)), ["g"], ["label"], merge, "label string, merged int")
    return labels.join(plan, "label").select(item, "label", "merged")


def fold_unassigned(cent: DataFrame, mapping: DataFrame) -> DataFrame:
    """(label, grp): clusters a proposed mapping leaves out join the nearest group, one after another.

    A group's centroid moves as clusters join it, so the fold is ordered; it sees one row per
    cluster (count and vector sum), never the members.
    """
    j = _summaries(cent).join(mapping.select("label", "grp"), "label", "left").select("g", F.coalesce("grp", F.lit(-1)).alias("grp"), "label", "n", "total")

    def fold(key, rows):
        groups: dict[int, np.ndarray] = {}
        for _, grp, label, _n, total in rows:
            if grp >= 0:
                groups[grp] = groups.get(grp, 0) + np.asarray(total, dtype=float)
                yield label, grp
        for _, grp, label, _n, total in rows:
            if grp < 0:
                v = np.asarray(total, dtype=float)
                sims = {g: float(np.dot(v, s) / max(np.linalg.norm(v) * np.linalg.norm(s), 1e-12)) for g, s in sorted(groups.items())}
                best = max(sims, key=lambda g: (sims[g], -g)) if sims else 0
                groups[best] = groups.get(best, 0) + v
                yield label, best

    return fold_sorted(j, ["g"], ["label"], fold, "label string, grp int")


def quality(features: DataFrame, labelings: DataFrame, item: str) -> DataFrame:
    """(method, clusters, silhouette): mean silhouette by cosine distance of every labeling (method, item, label).

    A row's mean distance to a cluster follows from the cluster's vector sum, so no two rows ever meet; all methods are
    one aggregate. A row alone in its cluster counts 0, as does every row of a method with one cluster.
    """
    rows = features.select(item, "unit").join(labelings.select("method", item, F.col("label").cast("string").alias("label")), item)
    long = rows.select("method", "label", F.posexplode("unit").alias("pos", "x")).groupBy("method", "label", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = cut_lineage(long.groupBy("method", "label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total")))
    met = rows.join(_small(sums.select("method", F.col("label").alias("c"), "n", "total")), "method")
    mean = 1 - VEC.dot(F.col("unit"), F.col("total")) / F.col("n")
    own = F.col("c") == F.col("label")
    per = met.groupBy("method", item).agg(
        F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own & (F.col("n") > 1), mean * F.col("n") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    s = F.when((F.col("n") == 1) | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy("method").agg(F.avg(s).alias("silhouette")).join(sums.groupBy("method").agg(F.count("*").alias("clusters")), "method").select("method", "clusters", "silhouette")


def k_sweep(labelings: DataFrame, max_size: int, max_k: int) -> DataFrame:
    """Per K: smallest and largest cluster, ratio; the chosen K fits both limits with the smallest ratio."""
    size = labelings.groupBy("k", "label").agg(F.count("*").alias("n"))
    s = size.groupBy("k").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.min("n").alias("smallest")).withColumn(
        "ratio", F.round(F.col("largest") / F.col("smallest"), 4))
    fits = (F.col("largest") <= max_size) & (F.col("k") <= max_k)
    best = s.agg(F.min(F.when(fits, F.struct("ratio", "k"))).alias("b")).select(F.col("b.k").alias("best"))
    return s.join(F.broadcast(best)).select("k", "clusters", "largest", "smallest", "ratio", F.coalesce(F.col("k") == F.col("best"), F.lit(False)).alias("chosen"))  # one row


def degree_precut(entities: DataFrame, n: int, degree: str, title: str) -> DataFrame:
    """Entities without the ``n`` best connected ones (a distributed top-n and an anti join)."""
    top = entities.orderBy(F.desc(degree), title).limit(n).select(title)
    return entities.join(top, title, "left_anti")
