"""Queries for clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import clustering as C
from inkstone.operators import stability as ST
from inkstone.plans.aggregates import part_degrees
from inkstone.plans.registry import query

L = F.lit


def features(t):
    return C.unit_features(t("embeddings"), "vec_id", "embedding")


def given(t):
    return t("embeddings").select("vec_id", F.col("label").cast("string").alias("label"))


@query("base_cluster")
def base_cluster(t):
    return C.base_cluster(features(t), "vec_id", 8)


@query("split_oversized")
def split_oversized(t):
    return C.split_oversized(features(t), given(t), "vec_id", max_size=20)


@query("merge_to_k")
def merge_to_k(t):
    return C.merge_to_k(features(t), given(t), "vec_id", 4)


@query("fold_unassigned")
def fold_unassigned(t):
    lab = given(t)
    mapping = lab.select("label").distinct().where("cast(label as int) % 3 <> 0").withColumn("grp", (F.col("label").cast("int") % 3).cast("int"))
    plan = C.fold_unassigned(C.centroids(features(t), lab, "vec_id"), mapping)
    return lab.join(plan, "label")


@query("cluster_quality", """WITH u AS (SELECT vec_id, label, unnest(range(len(v))) AS i, unnest(v) / greatest(sqrt(list_dot_product(v, v)), 1e-12) AS x FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)),
  l AS (SELECT vec_id, 'given' AS method, label::VARCHAR AS label FROM embeddings UNION ALL SELECT vec_id, 'paired', (label // 2)::VARCHAR FROM embeddings
    UNION ALL SELECT vec_id, 'dealt', (vec_id % 8)::VARCHAR FROM embeddings UNION ALL SELECT vec_id, 'lone', CASE WHEN vec_id = 7 THEN 'alone' ELSE (label % 3)::VARCHAR END FROM embeddings),
  c AS (SELECT method, l.label, i, sum(x) AS x, count(*) AS n FROM l JOIN u USING (vec_id) GROUP BY ALL),
  d AS (SELECT l.method, l.vec_id, l.label = c.label AS own, any_value(n) AS n, 1 - sum(u.x * c.x) / any_value(n) AS m FROM l JOIN u USING (vec_id) JOIN c ON c.method = l.method AND c.i = u.i GROUP BY l.method, l.vec_id, l.label, c.label),
  p AS (SELECT method, vec_id, max(n) FILTER (own) AS n, max(m * n / (n - 1)) FILTER (own AND n > 1) AS a, min(m) FILTER (NOT own) AS b FROM d GROUP BY method, vec_id),
  q AS (SELECT method, avg(CASE WHEN n = 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM p GROUP BY method)
  SELECT method, (SELECT count(DISTINCT label) FROM c WHERE c.method = q.method) AS clusters, round(s, 6) AS silhouette, method = (SELECT arg_max(method, s) FROM q) AS is_best FROM q""")
def cluster_quality(t):
    label, vec = F.col("label"), F.col("vec_id")
    ways = {"given": label.cast("string"), "paired": F.floor(label / 2).cast("string"), "dealt": (vec % 8).cast("string"),
            "lone": F.when(vec == 7, "alone").otherwise((label % 3).cast("string"))}
    labelings = t("embeddings").select("vec_id", F.inline(F.array(*[F.struct(L(k).alias("method"), v.alias("label")) for k, v in ways.items()])))
    q = C.quality(features(t), labelings, "vec_id")
    best = q.agg(F.max_by("method", "silhouette").alias("best"))
    return q.join(F.broadcast(best)).select("method", "clusters", F.round("silhouette", 6).alias("silhouette"), (F.col("method") == F.col("best")).alias("is_best"))  # one row


@query("k_sweep", """WITH s AS (SELECT k, (label * 7 + vec_id % 3) % k AS label, count(*) AS n FROM embeddings, range(2, 11) r(k) GROUP BY ALL),
  a AS (SELECT CAST(k AS INTEGER) AS k, count(*) AS clusters, max(n) AS largest, min(n) AS smallest, round(max(n) / CAST(min(n) AS DOUBLE), 4) AS ratio FROM s GROUP BY k)
  SELECT *, coalesce(k = (SELECT arg_min(k, (ratio, k)) FROM a WHERE largest <= 100 AND k <= 10), false) AS chosen FROM a""")
def k_sweep(t):
    e = t("embeddings").select("vec_id", "label", F.explode(F.sequence(L(2), L(10))).alias("k"))
    return C.k_sweep(e.select("k", ((F.col("label") * 7 + F.col("vec_id") % 3) % F.col("k")).alias("label")), 100, 10)


@query("degree_precut", "SELECT p_partkey, degree FROM v_part_deg ANTI JOIN (SELECT p_partkey FROM v_part_deg ORDER BY degree DESC, p_partkey LIMIT 40) USING (p_partkey)")
def degree_precut(t):
    return C.degree_precut(part_degrees(t).select("p_partkey", "degree"), 40, "degree", "p_partkey")


@query("partition_equal", """WITH a AS (SELECT label, count(*) AS size, list(vec_id ORDER BY vec_id) AS m FROM embeddings GROUP BY label),
  b AS (SELECT l, count(*) AS size, list(vec_id ORDER BY vec_id) AS m FROM (SELECT vec_id, CASE WHEN vec_id % 97 = 5 THEN 0 ELSE (label + 3) % 10 END AS l FROM embeddings) GROUP BY l)
  SELECT coalesce(a.size, b.size) AS size, a.m IS NOT NULL AS in_a, b.m IS NOT NULL AS in_b FROM a FULL JOIN b ON a.m = b.m""")
def partition_equal(t):
    e = t("embeddings")
    other = e.select("vec_id", F.when(F.col("vec_id") % 97 == 5, 0).otherwise((F.col("label") + 3) % 10).alias("label"))
    return ST.same_partition(e.select("vec_id", "label"), other, "vec_id", "label")
