"""Queries for graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import graph as G
from inkstone.plans import views as V
from inkstone.plans.registry import query, view_sql
from inkstone.plans.text import records

L = F.lit


@query("graph_build", """SELECT 'entity' AS kind, a, b, count(DISTINCT (l_orderkey, l_linenumber)) AS n, CAST(NULL AS DOUBLE) AS weight FROM v_record WHERE kind = 'entity' GROUP BY a, b
  UNION ALL SELECT 'relationship', a, b, count(DISTINCT (l_orderkey, l_linenumber)), sum(strength) FROM v_record WHERE kind = 'relationship' GROUP BY a, b""")
def graph_build(t):
    ents, edges = G.build(records(t), ["l_orderkey", "l_linenumber"])
    return ents.select(L("entity").alias("kind"), F.col("title").alias("a"), F.col("type").alias("b"), F.col("frequency").alias("n"), L(None).cast("double").alias("weight")).unionByName(
        edges.select(L("relationship").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("n_chunks").alias("n"), "weight"))


view_sql("v_gdeg", "SELECT title, count(DISTINCT nbr) AS degree FROM (SELECT source AS title, target AS nbr FROM v_graph UNION ALL SELECT target, source FROM v_graph) GROUP BY title")


@query("degrees", "SELECT g.*, a.degree + b.degree AS combined_degree FROM v_graph g JOIN v_gdeg a ON a.title = g.source JOIN v_gdeg b ON b.title = g.target")
def degrees(t):
    return G.combined_degrees(V.graph(t))


view_sql("v_strong", "SELECT source, target, weight FROM v_graph")
view_sql("v_two_way", "SELECT source AS v, target AS n FROM v_strong UNION ALL SELECT target, source FROM v_strong")
view_sql("v_comp", """WITH RECURSIVE r AS (SELECT DISTINCT v AS title, v AS x FROM v_two_way UNION SELECT r.title, e.n FROM r JOIN v_two_way e ON e.v = r.x) SELECT title, min(x) AS component FROM r GROUP BY title""")


def strong(t):
    return V.graph(t)


@query("largest_component", """WITH s AS (SELECT component, count(*) AS n FROM v_comp GROUP BY 1) SELECT title, component, component = (SELECT arg_min(component, (-n, component)) FROM s) AS kept FROM v_comp""")
def largest_component(t):
    return G.largest_component(strong(t))


@query("component_count", "SELECT count(DISTINCT component) AS islands, count(*) AS vertices FROM v_comp")
def component_count(t):
    return G.components(strong(t)).agg(F.count_distinct("component").alias("islands"), F.count("*").alias("vertices"))


@query("community_labels")
def community_labels(t):
    return G.community_labels(V.graph(t), max_size=300)


@query("community_hierarchy", """SELECT c.community, c.level, c.title, p.title AS parent_title, coalesce(k.n, 0) AS n_children, k.a AS first_child, k.b AS last_child FROM v_community c LEFT JOIN v_community p ON p.community = c.parent
  LEFT JOIN (SELECT parent, count(*) AS n, min(title) AS a, max(title) AS b FROM v_community GROUP BY parent) k ON k.parent = c.community""")
def community_hierarchy(t):
    return G.hierarchy(V.communities(t))
