"""Queries for cache-aware scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import scoring as SC
from inkstone.plans import views as V
from inkstone.plans.registry import query, view_sql

L = F.lit

view_sql("v_request", "SELECT doc_id, sha256('m' || (doc_id % 3) || chr(31) || 'system ' || lang || chr(31) || text) AS key FROM documents")


def requests(t):
    k = SC.cache_key(F.concat(L("m"), (F.col("doc_id") % 3).cast("string")), F.concat(L("system "), "lang"), F.col("text"))
    return t("documents").select("doc_id", k.alias("key"))


@query("cache_key", "SELECT * FROM v_request")
def cache_key(t):
    return requests(t)


@query("cache_split", """WITH c AS (SELECT DISTINCT key, CASE WHEN min(doc_id) % 4 = 0 THEN '' ELSE 'stored' END AS response FROM v_request GROUP BY key HAVING min(doc_id) % 2 = 0),
  a AS (SELECT key, min(doc_id) % 5 AS lag FROM v_request GROUP BY key)
  SELECT r.doc_id, r.key, c.key IS NOT NULL AS cached, CASE WHEN c.key IS NOT NULL THEN c.response WHEN a.lag < 3 THEN 'fresh' ELSE '' END AS response,
  CAST(CASE WHEN c.key IS NOT NULL THEN 0 WHEN a.lag < 3 THEN a.lag + 1 ELSE 3 END AS INTEGER) AS tries FROM v_request r LEFT JOIN c ON c.key = r.key JOIN a ON a.key = r.key""")
def cache_split(t):
    r = requests(t)
    per = r.groupBy("key").agg(F.min("doc_id").alias("d"))
    cache = per.where(F.col("d") % 2 == 0).select("key", F.when(F.col("d") % 4 == 0, "").otherwise("stored").alias("response"))
    tries = per.select("key", F.explode(F.sequence(L(0), L(5))).alias("attempt"), "d")
    attempts = tries.select("key", "attempt", F.when(F.col("attempt") >= F.col("d") % 5, "fresh").otherwise("").alias("response"))
    split = SC.cache_split(r, cache)
    misses = attempts.join(split.where(~F.col("cached")).select("key").distinct(), "key", "left_semi")
    return SC.fill_misses(split, misses)


@query("scored_map", "SELECT doc_id, title, degree, CAST(run AS INTEGER) AS run, CAST(degree AS DOUBLE) AS score FROM v_ent, (VALUES (0), (1)) r(run)")
def scored_map(t):
    return SC.scored_map(V.entities(t).select("doc_id", "title", "degree"), SC.degree_rule, runs=2)


@query("rubric_apply", """WITH m AS (SELECT doc_id, section, title, degree, title IN (SELECT title FROM v_ent GROUP BY title HAVING count(*) > 200) AS generic FROM v_room),
  k AS (SELECT doc_id, section, title, CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY degree DESC, title) AS INTEGER) AS rank FROM m WHERE NOT generic QUALIFY rank <= 2)
  SELECT m.*, CASE WHEN k.rank IS NULL THEN 'demoted' ELSE 'kept' END AS status, k.rank FROM m LEFT JOIN k ON k.doc_id = m.doc_id AND k.section = m.section AND k.title = m.title""")
def rubric_apply(t):
    generic = V.entities(t).groupBy("title").agg(F.count("*").alias("n")).where("n > 200")
    return SC.rubric_apply(V.rooms(t).select("doc_id", "section", "title", "degree"), ["doc_id", "section"], generic, 2)
